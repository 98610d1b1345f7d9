"""The notification outbox: an append-only parquet folder. Nothing here sends
anything; a person or another program reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolesift.schema import OUTBOX
from rolesift.sources.keyed import append_keyed, read_keyed


def write_outbox(strong: DataFrame, path: str) -> None:
    append_keyed(strong.select(*OUTBOX.names), path)


def read_outbox(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """All of the outbox, or with ``like`` at least what it has on those urls."""
    return read_keyed(spark, path, OUTBOX, like)
