"""Scoring postings as they arrive and putting strong fits in the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rolesift.functions.terms import STRONG_FIT
from rolesift.operators.pending import unnotified
from rolesift.operators.review import strong_fits
from rolesift.plans.flows import find_and_score
from rolesift.schema import SCORED
from rolesift.session import shared_dir
from rolesift.sources.files import remove
from rolesift.sources.keyed import append_keyed, read_keyed
from rolesift.sources.outbox import read_outbox, write_outbox

SIGHTING = T.StructType([f for f in SCORED.fields if f.name in ("posting_id", "url", "seen_at")])


def already_sent(outbox: DataFrame, strong: DataFrame) -> DataFrame:
    """The urls of ``strong`` that are in the outbox. While ``strong`` is a
    table small enough for Spark to broadcast, the outbox, which only grows, is
    read but not shuffled."""
    return outbox.select("url").join(strong.select("url"), "url", "left_semi")


def _age(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}seen_at"), F.col(f"{prefix}posting_id"))


def not_outdated(newest: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``newest`` without a newer sighting of their url in ``known``."""
    newer = known.groupBy("url").agg(F.max(_age()).alias("_known")).select(
        F.col("url").alias("_url"), "_known"
    )
    return newest.join(
        newer, (F.col("url") == F.col("_url")) & (F.col("_known") > _age()), "left_anti"
    )


def notify_batch(
    postings: DataFrame,
    rules: DataFrame,
    outbox: str,
    threshold: int = STRONG_FIT,
    sightings: str | None = None,
) -> None:
    """One batch of raw postings. A replayed batch adds nothing: its urls are in
    the outbox already. With ``sightings``, a folder, the newest sighting of
    every url is remembered there, and one that is older than what was already
    processed is never notified, however strong. Of both folders only the parts
    are read where the batch's urls can be."""
    spark = postings.sparkSession
    staged = shared_dir(spark, "strong")
    try:
        newest = find_and_score(postings, rules, description=False)
        # Used several times below. Written out, it is computed once and its
        # size is known.
        newest.write.parquet(f"{staged}/newest")
        newest = spark.read.schema(newest.schema).parquet(f"{staged}/newest")
        if sightings:
            newest = not_outdated(newest, read_keyed(spark, sightings, SIGHTING, newest))
        strong = strong_fits(newest, threshold)
        sent = already_sent(read_outbox(spark, outbox, strong), strong)
        write_outbox(unnotified(strong, sent), outbox)
        if sightings:
            append_keyed(newest.select(*SIGHTING.names), sightings)
    finally:
        remove(spark, staged)


def notify_stream(
    stream: DataFrame,
    rules: DataFrame,
    outbox: str,
    checkpoint: str,
    threshold: int = STRONG_FIT,
    sightings: str | None = None,
) -> StreamingQuery:
    """Starts a query over what has landed by now; it ends by itself. What it
    remembers of sightings is beside the outbox unless told otherwise."""
    sightings = sightings or f"{outbox.rstrip('/')}-sightings"
    return (
        stream.writeStream.foreachBatch(
            lambda batch, _: notify_batch(batch, rules, outbox, threshold, sightings)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
