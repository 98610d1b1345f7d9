"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

from rolesift.sources import files

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Merges small shuffle partitions, splits skewed ones and picks broadcasts
    # from sizes seen at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # First-sighting state holds one entry per url: keep it off the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(
    app: str = "rolesift",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with the settings above. On a cluster leave ``master`` to
    spark-submit and give ``shuffle_partitions`` about two to three times the
    number of cores: adaptive execution merges what is too small, but streaming
    state keeps the number it was started with."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders given out since the innermost ``scratch`` was entered.
_given: ContextVar[list[str] | None] = ContextVar("given", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rolesift-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/rolesift/{name}-{uuid.uuid4().hex}"
    given = _given.get()
    if given is not None:
        given.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, on leaving, the intermediate tables that operators called inside
    have written, also after an error. DataFrames made inside may still read
    them: write inside what is to stay, to a folder from outside."""
    given: list[str] = []
    before = _given.set(given)
    try:
        yield
    finally:
        _given.reset(before)
        for path in given:
            files.remove(spark, path)
