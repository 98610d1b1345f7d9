"""First sightings by Spark's own stateful operator, for callers who can bound
its state or do not need to.

``first_seen.run_first_seen`` keeps what it has seen in a folder: nothing is ever
too late, and the memory grows on disk. Here the urls are in the state store. It
answers without reading a folder, but holds every url for ever unless a ``delay``
says how late a sighting may come. Then a url is forgotten once the watermark is
a delay past its first sighting, and rows behind the watermark, which Spark drops
without a word, are put aside first and counted."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rolesift.sources.commits import commit_path, numbers
from rolesift.sources.files import create_text, names, read_text, remove
from rolesift.streaming.scan import scan_stream

LATE = "is_late"


def first_seen_by_state(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """One row of each url of a stream. With ``delay``, such as "30 days", state
    is bounded and a url whose sightings are a delay apart may come again."""
    if delay is None:
        return stream.dropDuplicates(["url"])
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["url"])


def _horizon(spark: SparkSession, folder: str, batch: int) -> int | None:
    """Microseconds of the newest time of the batches before; null if none."""
    before = [n for n in numbers(spark, folder) if n < batch]
    return json.loads(read_text(spark, commit_path(folder, before[-1]))) if before else None


def put_aside_late(stream: DataFrame, routed: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Writes what has landed to ``routed``, late rows apart from the others, and
    ends by itself. A row is late if its time is a ``delay`` or more before the
    newest of the batches before its own, if it has no time, or one before 1970.
    A batch that is replayed is written over."""

    def route(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder, horizons = f"{routed}/batch-{number:08d}", f"{routed}/_horizons"
        newest = _horizon(spark, horizons, number)
        late = F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")) <= 0, F.lit(True))
        if newest is not None:
            behind = F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {delay}")
            late |= F.col("seen_at").cast("timestamp") <= behind
        # Written apart, as one write into two folders would sort all rows of a task.
        for side, told in ((late, "true"), (~late, "false")):
            batch.filter(side).write.mode("overwrite").parquet(f"{folder}/{LATE}={told}")
        written = spark.read.schema(batch.schema).parquet(folder)
        top = written.agg(F.unix_micros(F.max("seen_at").cast("timestamp")).alias("top")).first().top
        if number in numbers(spark, horizons):
            remove(spark, commit_path(horizons, number))
        reached = [t for t in (top, newest) if t is not None]
        create_text(spark, commit_path(horizons, number), json.dumps(max(reached, default=None)))

    return (
        stream.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_late(spark: SparkSession, routed: str, schema: T.StructType) -> DataFrame:
    """The rows that ``put_aside_late`` has put aside."""
    folders = [f"{routed}/{n}" for n in names(spark, routed) if n.startswith("batch-")]
    late = [f"{f}/{LATE}=true" for f in folders if f"{LATE}=true" in names(spark, f)]
    if not late:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*late)


@dataclass
class Counts:
    """Of one run: rows taken, rows put aside as late, rows that the stateful
    operator dropped behind its watermark, and urls in its state at the end."""

    rows: int = 0
    late: int = 0
    dropped: int = 0
    in_state: int = 0


def run_first_seen_by_state(
    stream: DataFrame, sink: str, checkpoint: str, delay: str | None = None
) -> Counts:
    """Appends the first sightings of what has landed since the last run with this
    ``checkpoint`` to ``sink``. With ``delay``, late rows are under
    ``{sink}-routed``, see ``read_late``; the operator itself then drops none, as
    its watermark is never ahead of the time that they were held against."""
    spark, schema, counts = stream.sparkSession, stream.schema, Counts()
    routed = f"{sink.rstrip('/')}-routed"
    if delay is not None:
        before = read_late(spark, routed, schema).count()
        put_aside_late(stream, routed, f"{checkpoint}/routed", delay).awaitTermination()
        counts.late = read_late(spark, routed, schema).count() - before
        folders = [n for n in names(spark, routed) if n.startswith("batch-")]
        if not any(f"{LATE}=false" in names(spark, f"{routed}/{n}") for n in folders):
            return counts
        stream = scan_stream(spark, f"{routed}/batch-*/{LATE}=false", schema)
    query = (
        first_seen_by_state(stream, delay)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", f"{checkpoint}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counts.rows = counts.late
    for progress in query.recentProgress:
        counts.rows += progress.numInputRows
        for operator in progress.stateOperators:
            counts.dropped += operator.numRowsDroppedByWatermark
            counts.in_state = operator.numRowsTotal
    return counts
