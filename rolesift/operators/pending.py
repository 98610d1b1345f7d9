"""What is still to be done: anti-joins on the url.

A url may hold a large share of either side:

* A store or an outbox holds a url once, so it is joined as it is: one narrow
  shuffle of its urls, or none while they are small enough to broadcast. Reviews
  may repeat a url; they are reduced before they are shuffled, to one row per
  task. The reduction runs per slice of the table, not on the url alone: that
  leaves the join a shuffle of its own, which is the only shape in which
* adaptive execution splits a hot url of the left side over several tasks.

Spark broadcasts the right side only where its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 8


def _without(postings: DataFrame, done: DataFrame, unique: bool) -> DataFrame:
    urls = done.select("url")
    if not unique:
        part = F.spark_partition_id() % SLICES
        urls = done.select("url", part.alias("_slice")).distinct().select("url")
    return postings.join(urls, "url", "left_anti")


def new_postings(scan: DataFrame, store: DataFrame) -> DataFrame:
    """Postings whose url is not saved yet."""
    return _without(scan, store, unique=True)


def unnotified(strong: DataFrame, outbox: DataFrame) -> DataFrame:
    """Strong fits whose url is not in the outbox yet."""
    return _without(strong, outbox, unique=True)


def unreviewed(scored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Postings whose url nobody has reviewed yet."""
    return _without(scored, reviews, unique=False)
