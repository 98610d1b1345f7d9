"""Ordering and cutting scored postings for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.functions.terms import STRONG_FIT


def review_list(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Best first; the id decides ties, so equal scores still spread over the
    sorted partitions. With ``k`` only that many rows leave each task."""
    ordered = scored.orderBy(F.desc("score"), "posting_id")
    return ordered if k is None else ordered.limit(k)


def strong_fits(scored: DataFrame, threshold: int = STRONG_FIT) -> DataFrame:
    return scored.filter(F.col("score") >= threshold)
