"""Mixing: targets by repeated resharing, budgets, sampling by weight."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F


from llm_rows import awkward  # noqa: F401

from rolesift.llm.mixing import mix, mixed_documents, targets

SCHEMA = "doc_id long, text string, source string"


def shared_out(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing what is over, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, full = set(names), {}
    left = share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
        open_ -= over
    return full


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i}" if i else None: rng.randrange(1, 10 ** rng.randrange(1, 6)) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = shared_out(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9)
            assert got[s] <= 2 * sizes[s]
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    return [
        (i, " ".join(f"w{k}" for k in range(rng.randrange(40))), rng.choice(["a", "a", "a", "b", None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("bins", [1, 8, 1024])
def test_budgets_and_order(spark, bins):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    got = mix(df, bins=bins, keep=("doc_id", "source")).collect()
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = shared_out(sizes)
    assert len(got) == len(docs)
    for source, target in want.items():
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]}
        assert sum(r.taken for r in mine) == int(target)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        assert sum(0 < r.part < r.size for r in mine) <= 1
        epochs = int(target // sizes[source])
        assert {r.epochs for r in mine} == {epochs}
        # Whole epochs first, then a sample.
        assert all(r.taken >= epochs * r.size for r in mine)


def test_bins_change_nothing(spark):
    df = spark.createDataFrame(corpus(3), SCHEMA)
    assert rows(mix(df, bins=1)) == rows(mix(df, bins=64)) == rows(mix(df.repartition(5), bins=64))
    assert rows(mix(df, seed=1)) != rows(mix(df, seed=2))


def test_better_documents_are_taken_more_often(spark):
    rows_ = [(i, "good words here now" if i % 2 else "1#2 $3% 4*5 6|7", s)
             for i in range(6000) for s in ("a", "b")][:8000]
    df = spark.createDataFrame(rows_, SCHEMA).withColumn(
        "doc_id", F.col("doc_id") * 2 + (F.col("source") == "a").cast("int"))
    got = mix(df, share=0.5).groupBy((F.col("doc_id") >= 0).alias("x")).count()
    assert got.first()["count"] == 8000
    taken = mix(df, share=0.5, keep=("doc_id", "text")).filter("part > 0")
    good = taken.filter(F.col("text").startswith("good")).count()
    assert good > 2 * (taken.count() - good)


def test_whole_mixture(spark):
    docs = corpus(4)
    df = spark.createDataFrame(docs, SCHEMA).withColumn("size", F.lit("kept"))
    got = mixed_documents(df)
    assert got.columns == df.columns
    times = {}
    for r in got.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    picks = {r.doc_id: r for r in mix(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, text, _ in docs:
        p = picks[i]
        want = p.epochs + (2 * p.part >= p.size) if p.size else 1
        assert times.get(i, 0) == want <= 2
        assert all(len(text.split()) == p.size for _ in [0])


def test_awkward_rows(spark, awkward):
    got = mix(awkward).collect()
    assert len(got) == awkward.count()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in awkward.collect()}
    for r in got:
        if r.doc_id is not None:
            assert r["size"] == words[r.doc_id]
        assert r.taken <= 2 * r["size"]
    assert rows(mix(awkward)) == rows(mix(awkward))
    out = mixed_documents(awkward)
    assert out.select("_key", "__text_a", "size", "label").distinct().collect() == [("x",) * 4]
    assert out.columns == awkward.columns and out.count() >= 3
    assert mix(awkward.limit(0)).count() == 0 == mixed_documents(awkward.limit(0)).count()


def test_sources_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], SCHEMA)
    assert [(r.target, r.taken) for r in mix(df).collect()] == [(0.0, 0), (0.0, 0)]


def test_no_python_and_no_wide_sort(spark):
    plan = mix(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


def test_a_hot_source_is_spread(spark):
    """Only the bin at the border is put in order."""
    df = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    got = mix(df, keep=("doc_id", "source"))
    hot = got.filter("source = 'hot'").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).first()
    assert hot.t == int(hot.g)
