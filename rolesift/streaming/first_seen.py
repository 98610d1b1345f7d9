"""First sighting of each url across scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.session import shared_dir
from rolesift.sources.files import remove
from rolesift.sources.keyed import append_keyed, read_keyed

PERIOD = "seen_period"
KEY = T.StructType([T.StructField("url", T.StringType()), T.StructField(PERIOD, T.LongType())])
ORDER = ("seen_at", "posting_id", "page_id")


def _period(days: int | None) -> Column:
    """The number of the period a row belongs to; without periods there is one."""
    if days is None:
        return F.lit(0).cast("long")
    seconds = F.unix_timestamp(F.col("seen_at").cast("timestamp"))
    return F.floor(seconds / (days * 86_400)).cast("long")


def first_seen(
    batch: DataFrame, seen: DataFrame | None = None, days: int | None = None
) -> DataFrame:
    """The first row of each url of a batch, unless ``seen`` (url, seen_period)
    has it: the earliest, then the one with the smallest id. Adds seen_period.

    Without ``days`` a url is new once and for all. With it time is divided into
    periods of so many days, and a url is new once in each. Whether a row is new
    depends on its own time and not on what else has arrived, so a row that comes
    late is as good as any, and only the periods that a batch touches matter.

    Spark keeps one row per url and task before the shuffle, so a hot url is no
    burden. A null url is a url."""
    order = [F.col(c) for c in ORDER if c in batch.columns]
    first = Window.partitionBy("url", PERIOD).orderBy(*order, F.xxhash64(*batch.columns))
    once = (
        batch.withColumn(PERIOD, _period(days))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
    if seen is None:
        return once
    known = seen.select(F.col("url").alias("_url"), F.col(PERIOD).alias("_period"))
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col(PERIOD).eqNullSafe(F.col("_period"))
    return once.join(known, same, "left_anti")


def keep_first_seen(
    batch: DataFrame,
    sink: str,
    days: int | None = None,
    then: Callable[[DataFrame], None] | None = None,
) -> None:
    """Hands a batch's first sightings to ``then`` and appends them to ``sink``,
    which is also the memory of what was seen; of it only the parts are read
    where the batch's urls and periods can be. A replayed batch adds nothing."""
    spark = batch.sparkSession
    staged = shared_dir(spark, "first-seen")
    try:
        # Used twice below. Written out, it is computed once and its size is known.
        once = first_seen(batch, days=days)
        once.write.parquet(f"{staged}/once")
        once = spark.read.schema(once.schema).parquet(f"{staged}/once")
        seen = read_keyed(spark, sink, KEY, once)
        if days is not None:
            touched = once.agg(F.min(PERIOD).alias("low"), F.max(PERIOD).alias("high")).first()
            if touched.low is not None:
                seen = seen.filter(F.col(PERIOD).between(touched.low, touched.high))
        first_seen(once.drop(PERIOD), seen, days).write.parquet(f"{staged}/new")
        new = spark.read.schema(once.schema).parquet(f"{staged}/new")
        if then:
            then(new.drop(PERIOD))
        append_keyed(new, sink)
    finally:
        remove(spark, staged)


def read_first_seen(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The first sightings in ``sink``, in the schema of the stream."""
    period = T.StructField(PERIOD, T.LongType())
    return read_keyed(spark, sink, T.StructType([*schema.fields, period])).select(*schema.names)


def run_first_seen(
    stream: DataFrame, sink: str, checkpoint: str, days: int | None = None
) -> None:
    """Takes what has landed since the last run with this ``checkpoint`` and
    appends its first sightings to ``sink``, batch by batch."""
    (
        stream.writeStream.foreachBatch(lambda batch, _: keep_first_seen(batch, sink, days))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
