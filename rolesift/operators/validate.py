"""Validation of raw postings against the fixed schema."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.schema import POSTING

REASON = "reject_reason"


def _typed(df: DataFrame) -> dict[str, Column]:
    """The posting fields in their types. Missing columns and values that do
    not fit are null."""
    return {
        f.name: F.col(f.name).try_cast(f.dataType) if f.name in df.columns
        else F.lit(None).cast(f.dataType)
        for f in POSTING.fields
    }


def _required(df: DataFrame) -> dict[str, Column]:
    """What a valid posting has, by the reason given where it is missing.
    Location and description may be null."""
    typed = _typed(df)
    return {
        "bad_posting_id": typed["posting_id"].isNotNull(),
        "bad_seen_at": typed["seen_at"].isNotNull(),
        "no_title": typed["title"].rlike(r"\S"),
        "no_url": typed["url"].rlike(r"\S"),
    }


def check_postings(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: the reasons, comma-joined, or null when valid."""
    reasons = [
        F.when(~F.coalesce(holds, F.lit(False)), reason)
        for reason, holds in _required(df).items()
    ]
    return df.withColumn(REASON, F.nullif(F.concat_ws(",", *reasons), F.lit("")))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: the first in the posting schema with any other
    columns after it, the second as it came plus its reasons. Each is its own
    lazy plan; a job that needs both in one pass can write ``check_postings``."""
    typed = _typed(df)
    others = [c for c in df.columns if c not in typed]
    valid = df.filter(reduce(and_, _required(df).values())).select(
        *[c.alias(name) for name, c in typed.items()], *others
    )
    return valid, check_postings(df).filter(F.col(REASON).isNotNull())
