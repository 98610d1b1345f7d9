"""Append-only parquet folders that are asked by url, and grow for ever.

A folder is a list of runs. An append writes its rows as one more run and commits
the list, so a batch costs what it holds, and rows of a batch that dies half-way
are in no list. Eight runs of a size are merged into one; thus a row is written a
logarithmic number of times, and a folder has few runs however many batches it
took.

The larger a run, the more parts it is laid out in by a hash of the url, so a
part stays at some ``PART_BYTES``, and the question which of a thousand urls are
in a large folder reads a thousand parts of it at the most.

One writer at a time, and any number of readers: what a merge replaces is removed
by the merge after it."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rolesift.sources.commits import commit, commit_path, newest, numbers
from rolesift.sources.files import names, remove, size
from rolesift.sources.parts import PART_BYTES, part_count, parts_with, read_parts, write_parts

COMMITS = "_commits"
FAN = 8
SMALL_BYTES = 64 << 10


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}/{COMMITS}"


def runs(spark: SparkSession, path: str) -> list[dict]:
    """The folder's runs: their ``folder``, ``schema``, number of ``parts`` and
    ``bytes``."""
    said = newest(spark, _commits(path))[1]
    return said["runs"] if said else []


def _write(df: DataFrame, path: str, n_bytes: int | None, part_bytes: int) -> dict:
    """Writes a run. Without ``n_bytes`` its size is not known before."""
    spark, folder = df.sparkSession, f"run-{uuid.uuid4().hex}"
    where = f"{path.rstrip('/')}/{folder}"
    parts = 1 if n_bytes is None else part_count(n_bytes, part_bytes)
    try:
        write_parts(df, where, parts)
        schema = json.loads(df.schema.json())
        return {"folder": folder, "schema": schema, "parts": parts, "bytes": size(spark, where)}
    except BaseException:
        remove(spark, where)
        raise


def _tier(run: dict) -> int:
    return (run["bytes"] // SMALL_BYTES).bit_length() // (FAN.bit_length() - 1)


def _due(found: list[dict], part_bytes: int) -> list[dict]:
    """The runs to merge: one that is too large for its parts, or the smallest
    that are ``FAN``."""
    for run in found:
        if run["bytes"] > 2 * run["parts"] * part_bytes:
            return [run]
    for tier in sorted({_tier(run) for run in found}):
        small = [run for run in found if _tier(run) <= tier]
        if len(small) >= FAN:
            return small
    return []


def _merge(spark: SparkSession, path: str, merged: list[dict], part_bytes: int) -> None:
    """Writes runs as one, with every column that any of them has, and commits it
    in their place."""
    fields: dict[str, T.StructField] = {}
    for run in merged:
        for field in T.StructType.fromJson(run["schema"]).fields:
            fields.setdefault(field.name, field)
    schema = T.StructType(list(fields.values()))
    total = sum(run["bytes"] for run in merged)
    made = _write(_union(spark, path, schema, merged), path, total, part_bytes)
    gone = [run["folder"] for run in merged]
    before: list[str] = []

    def change(said: dict) -> dict:
        before[:] = said["gone"]
        kept = [run for run in said["runs"] if run["folder"] not in gone]
        return {"runs": [*kept, made], "gone": gone}

    last = commit(spark, _commits(path), change)
    for folder in before:
        remove(spark, f"{path.rstrip('/')}/{folder}")
    for number in numbers(spark, _commits(path)):
        if number < last - 1:
            remove(spark, commit_path(_commits(path), number))


def _union(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    found: list[dict],
    chosen: set[int] | None = None,
) -> DataFrame:
    """The rows of runs; those of one part are read together."""
    single = [f"{path.rstrip('/')}/{run['folder']}" for run in found if run["parts"] == 1]
    tables = [
        read_parts(spark, f"{path.rstrip('/')}/{run['folder']}", schema, run["parts"], chosen)
        for run in found
        if run["parts"] > 1
    ]
    if single:
        tables.append(spark.read.schema(schema).parquet(*single))
    if not tables:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, tables)


def append_keyed(df: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """Appends rows with a ``url``, and merges the runs that have become many."""
    spark = df.sparkSession
    run = _write(df, path, None, part_bytes)

    def change(said: dict | None) -> dict:
        said = said or {"runs": [], "gone": []}
        return {"runs": [*said["runs"], run], "gone": said["gone"]}

    commit(spark, _commits(path), change)
    due = _due(runs(spark, path), part_bytes)
    while due:
        _merge(spark, path, due, part_bytes)
        due = _due(runs(spark, path), part_bytes) if len(due) > 1 else []


def compact_keyed(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> None:
    """Writes all runs as one, one file for each part, and removes what batches
    that died have left. While nobody appends; readers are not disturbed."""
    found = runs(spark, path)
    if not found:
        return
    if len(found) > 1 or found[0]["parts"] != part_count(found[0]["bytes"], part_bytes):
        _merge(spark, path, found, part_bytes)
    said = newest(spark, _commits(path))[1]
    named = {COMMITS, *said["gone"], *(run["folder"] for run in said["runs"])}
    for name in set(names(spark, path)) - named:
        remove(spark, f"{path.rstrip('/')}/{name}")


def read_keyed(
    spark: SparkSession, path: str, schema: T.StructType, like: DataFrame | None = None
) -> DataFrame:
    """The folder's rows; with ``like``, at least those whose url stands in it."""
    found = runs(spark, path)
    most = max((run["parts"] for run in found), default=1)
    chosen = parts_with(like, most) if like is not None and most > 1 else None
    return _union(spark, path, schema, found, chosen)
