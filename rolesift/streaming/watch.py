"""The scheduled flow: pages that have landed, first sightings, notification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rolesift.functions.terms import STRONG_FIT
from rolesift.operators.extract import postings_from_pages
from rolesift.streaming.first_seen import keep_first_seen
from rolesift.streaming.notify import notify_batch
from rolesift.streaming.scan import scan_stream


def watch_pages(
    spark: SparkSession,
    landing: str,
    rules: DataFrame,
    seen: str,
    outbox: str,
    checkpoint: str,
    threshold: int = STRONG_FIT,
    seen_at: Column | None = None,
    location: Column | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Starts a query over the pages that have landed by now; it ends by itself.
    The postings of pages whose url was not seen before are scored, and strong
    fits go to the outbox. They are notified before they count as seen, so a
    batch that dies is taken again as a whole, and the outbox repeats nothing."""
    postings = postings_from_pages(
        scan_stream(spark, landing, max_files=max_files), seen_at, location
    )

    def take(batch: DataFrame, _: int) -> None:
        keep_first_seen(
            batch, seen, then=lambda new: notify_batch(new, rules, outbox, threshold)
        )

    return (
        postings.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
