"""Folders that grow by appends: same rows, few runs, few files, whatever dies."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rolesift.schema import OUTBOX
from rolesift.sources import keyed
from rolesift.sources.commits import commit, newest, numbers
from rolesift.sources.keyed import append_keyed, compact_keyed, read_keyed, runs
from rolesift.sources.parts import part_count


def batch(spark, low, high):
    return spark.range(low, high, numPartitions=1).select(
        F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("score"),
        F.lit("").alias("matched_rules"),
    )


def files(folder):
    return [n for _, _, names in os.walk(folder) for n in names if n.endswith(".parquet")]


def test_part_counts():
    assert [part_count(n, 10) for n in (0, 10, 11, 20, 21, 40, 41, 1000)] == [1, 1, 2, 2, 4, 4, 8, 128]


def test_many_appends_leave_few_runs(spark, tmp_path):
    path = f"{tmp_path}/folder"
    assert read_keyed(spark, path, OUTBOX).count() == 0
    for k in range(20):
        append_keyed(batch(spark, 10 * k, 10 * k + 10), path)
        assert len(runs(spark, path)) < keyed.FAN
    assert rows(read_keyed(spark, path, OUTBOX)) == rows(batch(spark, 0, 200))
    assert len(numbers(spark, f"{path}/_commits")) < 2 * keyed.FAN


def test_compaction_leaves_one_file_for_each_part(spark, tmp_path):
    path = f"{tmp_path}/folder"
    for k in range(3):
        append_keyed(batch(spark, 1000 * k, 1000 * k + 1000), path)
    open_before = read_keyed(spark, path, OUTBOX)
    compact_keyed(spark, path, part_bytes=2 << 10)
    (run,) = runs(spark, path)
    assert run["parts"] > 4 and len(files(f"{path}/{run['folder']}")) == run["parts"]
    assert rows(read_keyed(spark, path, OUTBOX)) == rows(batch(spark, 0, 3000))
    assert open_before.count() == 3000  # a reader of what was before
    few = batch(spark, 70, 73)
    got = read_keyed(spark, path, OUTBOX, few)
    assert rows(got.join(few, "url", "left_semi")) == rows(few) and got.count() < 3000
    # Layouts of different sizes answer together.
    append_keyed(batch(spark, 3000, 3010), path)
    assert rows(read_keyed(spark, path, OUTBOX)) == rows(batch(spark, 0, 3010))
    compact_keyed(spark, path, part_bytes=1 << 20)
    assert [r["parts"] for r in runs(spark, path)] == [1]
    assert rows(read_keyed(spark, path, OUTBOX)) == rows(batch(spark, 0, 3010))


def test_what_dies_before_its_commit_is_in_no_list(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/folder"
    append_keyed(batch(spark, 0, 5), path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed, "commit", dies)
        with pytest.raises(RuntimeError):
            append_keyed(batch(spark, 5, 10), path)
        with pytest.raises(RuntimeError):
            compact_keyed(spark, path, part_bytes=64)
    assert rows(read_keyed(spark, path, OUTBOX)) == rows(batch(spark, 0, 5))
    append_keyed(batch(spark, 5, 10), path)
    compact_keyed(spark, path)
    said = newest(spark, f"{path}/_commits")[1]
    named = {"_commits", *said["gone"], *(r["folder"] for r in said["runs"])}
    assert set(os.listdir(path)) == named
    assert rows(read_keyed(spark, path, OUTBOX)) == rows(batch(spark, 0, 10))


def test_columns_of_all_runs_are_kept(spark, tmp_path):
    path = f"{tmp_path}/folder"
    append_keyed(batch(spark, 0, 2), path)
    append_keyed(batch(spark, 2, 4).withColumn("more", F.lit("x")), path)
    compact_keyed(spark, path)
    wide = batch(spark, 0, 1).withColumn("more", F.lit("x")).schema
    assert sorted((r.url, r.more) for r in read_keyed(spark, path, wide).collect()) == [
        ("u0", None), ("u1", None), ("u2", "x"), ("u3", "x")]


def test_a_commit_that_comes_second_is_made_again(spark, tmp_path):
    """Another writer commits between this one's look and its commit."""
    folder, others = f"{tmp_path}/commits", iter([["other"], ["another"]])

    def change(said):
        other = next(others, None)
        if other:
            commit(spark, folder, lambda before: {"had": [*(before or {"had": []})["had"], *other]})
        return {"had": [*(said or {"had": []})["had"], "mine"]}

    assert commit(spark, folder, change) == 3
    assert newest(spark, folder) == (3, {"had": ["other", "another", "mine"]})


def test_a_commit_without_content_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rolesift.sources.commits.WRITING_SECONDS", 2.0)
    folder = f"{tmp_path}/commits"
    commit(spark, folder, lambda _: {"a": 1})
    open(f"{folder}/00000002", "w").close()
    assert commit(spark, folder, lambda said: {**said, "b": 2}) == 3
    assert newest(spark, folder) == (3, {"a": 1, "b": 2})
