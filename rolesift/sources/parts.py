"""Rows laid out by a hash of their url, in as many parts as their size asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.sources.files import names

PART = "url_part"
PART_BYTES = 16 << 20


def part_of(url: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(parts)).cast("int")


def part_count(n_bytes: int, part_bytes: int = PART_BYTES) -> int:
    """A power of two, so that a finer layout divides the parts of a coarser."""
    return 1 << max(0, -(-n_bytes // part_bytes) - 1).bit_length()


def write_parts(df: DataFrame, folder: str, parts: int) -> None:
    """Writes rows with a ``url`` to a new folder, one file for each part that
    has any. A single part is written as Spark likes, in few files."""
    if parts == 1:
        df.hint("rebalance").write.parquet(folder)
        return
    df.withColumn(PART, part_of(F.col("url"), parts)).repartition(PART).sortWithinPartitions(
        PART, "url"
    ).write.partitionBy(PART).parquet(folder)


def parts_with(urls: DataFrame, parts: int) -> set[int]:
    """The parts where the urls can be: at most ``parts`` numbers are fetched."""
    if parts == 1:
        return {0}
    found = urls.select(part_of(F.col("url"), parts).alias("part")).distinct()
    return {r.part for r in found.collect()}


def read_parts(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    parts: int,
    chosen: set[int] | None = None,
) -> DataFrame:
    """The rows of a folder of ``write_parts``. With ``chosen``, numbers of the
    same or a finer layout, at least those that can be there; nothing else is
    even listed."""
    reader = spark.read.schema(schema)
    if parts == 1 or chosen is None:
        return reader.parquet(folder).select(*schema.names)
    wanted = {f"{PART}={c % parts}" for c in chosen}
    there = sorted(n for n in names(spark, folder) if n in wanted)
    if not there:
        return spark.createDataFrame([], schema)
    return reader.parquet(*[f"{folder}/{name}" for name in there])
