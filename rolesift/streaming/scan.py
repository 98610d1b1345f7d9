"""Incremental scans of a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rolesift.schema import PAGE


def scan_stream(
    spark: SparkSession,
    landing: str,
    schema: T.StructType = PAGE,
    max_files: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Files of ``landing`` (a folder or a glob) as a stream. ``max_files``
    bounds one micro-batch when a large backlog is waiting. With ``archive``, a
    folder outside of ``landing``, the files of a batch are moved there once a
    later batch has begun, so a run lists what is new and no longer all that has
    ever landed. Only one stream may then read ``landing``."""
    reader = spark.readStream.schema(schema)
    if archive:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(landing)


def run_scan(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Appends what is new since the last run with this ``checkpoint`` to
    ``sink`` and stops. Each file is taken once, also after a crash."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
