"""The posting store: a base table, the saves since, and a list of both.

A save writes its own rows as one more delta and never touches what is there, so
it costs what the batch costs, not what the store holds. Reading merges base and
deltas; ``compact`` writes the merged rows as a new base; ``retain`` removes what
older versions alone still need.

A version is a file in ``_versions`` that names its folders. It is written last
and only if its number is free, so a job that dies half-way leaves the store as it
was. Of two writers at the same time the second adds its delta to what the first
has left, and on a tie in age it counts as the later save. Any number of readers.

The base is laid out by a hash of the url in as many parts as its size asks for,
so a question about some urls reads those parts of it alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.operators.latest import latest
from rolesift.schema import SCORED
from rolesift.sources.commits import commit, commit_path, newest, numbers, read_commit
from rolesift.sources.files import names, remove, size
from rolesift.sources.parts import PART_BYTES, part_count, parts_with, read_parts, write_parts

VERSIONS = "_versions"
SAVE = "_save"
NOTHING = {"base": None, "parts": 1, "deltas": []}


def _versions(store: str) -> str:
    return f"{store.rstrip('/')}/{VERSIONS}"


def _folder(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the committed versions, oldest first: one listing."""
    return numbers(spark, _versions(store))


def _deltas(spark: SparkSession, store: str, folders: list[str]) -> DataFrame:
    """The rows of deltas, each with the place of its delta in the list."""
    rows = spark.read.schema(SCORED).parquet(*[_folder(store, f) for f in folders])
    name = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1)
    place = F.create_map(*[F.lit(x) for n, f in enumerate(folders) for x in (f, n)])
    return rows.withColumn(SAVE, F.element_at(place, name))


def _conform(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCORED.fields
        ]
    )


def _newest(deltas: DataFrame) -> DataFrame:
    """One row per url of several saves: as ``latest``, the later save on a tie."""
    newest = Window.partitionBy("url").orderBy(
        F.desc("seen_at"), F.desc("posting_id"), F.desc(SAVE)
    )
    ranked = deltas.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def merge_newest(saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest per url of two tables that each hold a url once; ``fresh`` wins a
    tie, so a posting can be scored again. Same result as a union followed by
    ``latest``, but the large side keeps its place: while the urls of ``fresh``
    are small enough for Spark to broadcast, ``saved`` is not shuffled."""

    def age(prefix: str = "") -> Column:
        return F.struct(F.col(f"{prefix}seen_at"), F.col(f"{prefix}posting_id"))

    def ages(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("url").alias("_url"),
            F.col("seen_at").alias("_seen_at"),
            F.col("posting_id").alias("_posting_id"),
        )

    same_url = F.col("url") == F.col("_url")
    kept = saved.join(ages(fresh), same_url & (age("_") >= age()), "left_anti")
    rivals = ages(saved).join(fresh.select("url"), same_url, "left_semi")
    added = fresh.join(rivals, same_url & (age("_") > age()), "left_anti")
    return kept.unionByName(added)


def _commit(
    spark: SparkSession,
    store: str,
    folder: str,
    write: Callable[[str], None],
    change: Callable[[dict | None], dict | None],
) -> int | None:
    """Writes rows to a new folder and then the version that names it. If either
    fails, or nothing is to be committed, the folder goes."""
    version = None
    try:
        write(_folder(store, folder))
        version = commit(spark, _versions(store), change)
    finally:
        if version is None:
            remove(spark, _folder(store, folder))
    return version


def save_postings(postings: DataFrame, store: str) -> int:
    """Saves postings by url, newest kept, and returns the new version number.
    Saving the same postings twice changes nothing. Postings must be valid."""
    fresh = latest(_conform(postings))
    folder = f"delta-{uuid.uuid4().hex}"

    def change(said: dict | None) -> dict:
        said = said or NOTHING
        return {**said, "deltas": [*said["deltas"], folder]}

    return _commit(
        postings.sparkSession, store, folder,
        lambda where: fresh.write.mode("errorifexists").parquet(where), change,
    )


def _is_on_url(spark: SparkSession, where: Column | str) -> bool:
    """Whether a filter asks for nothing but the url, and always the same."""
    try:
        asked = spark.createDataFrame([], "url string").filter(where)
        return asked._jdf.queryExecution().analyzed().deterministic()
    except AnalysisException:
        return False


def list_postings(
    spark: SparkSession,
    store: str,
    where: Column | str | None = None,
    version: int | None = None,
    urls: DataFrame | None = None,
) -> DataFrame:
    """Saved postings of the newest (or the given) version. ``urls``, a table
    with a ``url``, asks for those alone: of the base only the parts are read
    where they can be, and neither base nor deltas are merged for the rest. A
    filter on the url alone is applied before the merge as well."""
    if version is None:
        said = newest(spark, _versions(store))[1]
        if said is None:
            return spark.createDataFrame([], SCORED)
    else:
        said = read_commit(spark, _versions(store), version) if version in versions(spark, store) else None
        if said is None:
            raise ValueError(f"no version {version} in {store}")

    early = where is not None and _is_on_url(spark, where)

    def asked(rows: DataFrame) -> DataFrame:
        rows = rows.filter(where) if early else rows
        if urls is None:
            return rows
        return rows.join(urls.select("url"), "url", "left_semi").select(*rows.columns)

    tables = []
    if said["base"]:
        chosen = parts_with(urls, said["parts"]) if urls is not None else None
        folder = _folder(store, said["base"])
        tables.append(asked(read_parts(spark, folder, SCORED, said["parts"], chosen)))
    if said["deltas"]:
        deltas = asked(_deltas(spark, store, said["deltas"]))
        # A single delta holds each url once.
        tables.append((_newest(deltas) if len(said["deltas"]) > 1 else deltas).drop(SAVE))
    saved = reduce(merge_newest, tables)
    return saved if where is None or early else saved.filter(where)


def compact(spark: SparkSession, store: str, part_bytes: int = PART_BYTES) -> int:
    """Writes the newest version as one base table, as a new version that lists
    the same postings and is read without a merge. What is saved meanwhile stays
    a delta; of two that compact at the same time, one does."""
    version, said = newest(spark, _versions(store))
    if said is None:
        raise ValueError(f"nothing is saved in {store}")
    if not said["deltas"]:
        return version
    merged = [said["base"], *said["deltas"]] if said["base"] else said["deltas"]
    parts = part_count(sum(size(spark, _folder(store, f)) for f in merged), part_bytes)
    folder = f"base-{uuid.uuid4().hex}"

    def change(now: dict) -> dict | None:
        if now["base"] != said["base"]:
            return None
        since = [f for f in now["deltas"] if f not in said["deltas"]]
        return {"base": folder, "parts": parts, "deltas": since}

    made = _commit(
        spark, store, folder,
        lambda where: write_parts(list_postings(spark, store, version=version), where, parts),
        change,
    )
    return made or newest(spark, _versions(store))[0]


def retain(spark: SparkSession, store: str, newest: int = 1) -> None:
    """Removes all but the newest versions, and every folder that none of those
    needs, those of saves that died included. Not while somebody saves, or reads
    an older version."""
    if newest < 1:
        raise ValueError("the newest version stays")
    committed = versions(spark, store)
    if not committed:
        return
    keep = committed[-newest:]
    needed = {VERSIONS}
    for version in keep:
        said = read_commit(spark, _versions(store), version) or NOTHING
        needed |= {said["base"], *said["deltas"]}
    # Versions first: none may name a folder that is gone.
    for version in committed[:-newest]:
        remove(spark, commit_path(_versions(store), version))
    for name in set(names(spark, store)) - needed:
        remove(spark, _folder(store, name))
