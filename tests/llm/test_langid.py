"""Language ID: forward-backward against enumeration, code-switching, held-out."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from llm_rows import awkward  # noqa: F401

from rolesift.llm import langid
from rolesift.llm.arrays import text_groups
from rolesift.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def brute_force(scores, transitions, starts):
    n, k = scores.shape
    p = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = starts[path[0]] + sum(scores[i, path[i]] for i in range(n))
        w += sum(transitions[path[i - 1], path[i]] for i in range(1, n))
        for i in range(n):
            p[i, path[i]] += np.exp(w)
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [2, 3, 256])
def test_forward_backward(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(block)
    sizes = [1, 5, 1, 7, 6, 2]
    scores = rng.normal(size=(sum(sizes), 3)) * 3
    transitions, starts = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    first = np.zeros(len(scores), dtype=bool)
    ends = np.cumsum(sizes)
    first[ends - sizes] = True
    got = langid.marginals(scores, first, transitions, starts)
    for end, size in zip(ends, sizes):
        want = brute_force(scores[end - size : end], transitions, starts)
        assert np.allclose(got[end - size : end], want)


@pytest.mark.parametrize("cells", [3, 12, 30])
def test_chain_in_parts(monkeypatch, cells):
    """Parts of one, four and ten words give what the whole chains give."""
    rng = np.random.default_rng(cells)
    scores = rng.normal(size=(57, 3)) * 3
    transitions, starts = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    first = np.isin(np.arange(57), [0, 1, 20, 50])
    row = rng.integers(0, 57, 57)
    whole = langid.marginals(scores[row], first, transitions, starts)
    assert np.allclose(whole[50:], brute_force(scores[row][50:], transitions, starts))
    monkeypatch.setattr(langid, "CELLS", cells)
    assert np.allclose(langid.marginals(scores, first, transitions, starts, row), whole)


def test_evidence_crosses_parts(monkeypatch):
    """Words that tell nothing follow the one word that does, parts away."""
    scores = np.zeros((400, 2))
    scores[0, 1] = 9.0
    stay = np.log(np.array([[0.9999, 0.0001], [0.0001, 0.9999]]))
    monkeypatch.setattr(langid, "CELLS", 20)
    got = langid.marginals(scores, np.arange(400) == 0, stay, np.zeros(2))
    assert (got[:, 1] > 0.9).all()
    scores = scores[::-1].copy()
    assert (langid.marginals(scores, np.arange(400) == 0, stay, np.zeros(2))[:, 1] > 0.9).all()


def test_long_chains_do_not_underflow():
    scores = np.zeros((20_000, 2))
    scores[:, 0] = -50
    got = langid.marginals(scores, np.arange(20_000) == 0, np.full((2, 2), -30.0), np.zeros(2))
    assert np.isfinite(got).all() and (got[:, 1] > 0.99).all()


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_on(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = QUERIES["op2_language"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").agg(
        F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")
    ).first()
    assert found.count() == docs.count()
    assert held.n > 200 and held.right >= 0.98 * held.n
    assert found.filter("score < 0 or score > 1").count() == 0


def test_learns_from_no_held_out_label(spark):
    """Wrong labels in the held-out part change nothing."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    spoilt = docs.withColumn(
        "lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))
    )
    a, b = langid.fit_on(docs), langid.fit_on(spoilt)
    assert a.languages == b.languages == ["de", "en", "es", "fr"]
    assert (a.weights == b.weights).all()


def test_words_of_mixed_text(spark, model):
    """Every word of a text that changes its language gets a label."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id")
    some = {r.lang: " ".join(r.text.split()[:40]) for r in
            docs.filter(~F.col("text").rlike("[0-9#|!]")).select("lang", "text").collect()}
    parts = [some["fr"], some["en"], some["de"]]
    texts = next(text_groups(pa.array([" ".join(parts)])))
    p, bounds = langid.label_words(model, texts)
    best = [model.languages[k] for k in p.argmax(axis=1)]
    assert bounds[-1] == len(best)
    third = len(best) // 3
    for k, lang in enumerate(("fr", "en", "de")):
        inner = best[k * third + 8 : (k + 1) * third - 8]
        assert inner.count(lang) >= 0.8 * len(inner)


def test_evenly_mixed_text_is_kept(spark, model):
    """No language has 0.4 of the words, and each word's label is sure."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id")
    some = {r.lang: " ".join(r.text.split()[:40]) for r in
            docs.filter(~F.col("text").rlike("[0-9#|!]")).select("lang", "text").collect()}
    mixed = spark.createDataFrame(
        [(1, " ".join(some[lang] for lang in ("fr", "en", "de")))], "doc_id long, text string"
    )
    assert langid.identify(mixed, model).first().score < 0.4
    assert langid.keep_identified(mixed, model).count() == 1


def test_awkward_rows(spark, awkward, model):
    got = langid.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (1, 2, 3, 7):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    for i in (4, 8, 9, 10):
        assert by_id[i].lang_pred in model.languages and 0 < by_id[i].score <= 1
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = langid.keep_identified(awkward, model, least_score=0.0)
    assert kept.select("_key", "__text_a", "size", "label").distinct().collect() == [("x",) * 4]
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-3, 4, 5, 5, 8, 9, 10]


def test_nothing_to_learn_from(spark, awkward):
    assert langid.fit_on(awkward).languages == []
    assert {r.lang_pred for r in langid.identify(awkward, langid.fit_on(awkward)).collect()} == {"und"}
    empty = awkward.limit(0)
    assert langid.identify(empty, langid.fit_on(empty)).count() == 0


def test_one_language_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d", "en"), (1, "a b c d", "en"), (3, "c d", None)],
        "doc_id long, text string, lang string",
    )
    got = langid.identify(docs, langid.fit_on(docs))
    assert {(r.lang_pred, r.score) for r in got.collect()} == {("en", 1.0)}
    assert rows(got) == rows(langid.identify(docs, langid.fit_on(docs)))


def test_more_languages_than_sixty_four(spark):
    """Every language that labels a row is learned."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    docs = []
    for lang in range(70):
        own = ["".join(rng.choice(letters, 6)) for _ in range(12)]
        for _ in range(9):
            docs.append((len(docs), " ".join(rng.choice(own, 20)), f"l{lang:02}"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit_on(df)
    assert model.languages == [f"l{lang:02}" for lang in range(70)]
    got = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert len(held) > 70 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_long_text_is_one_chain(spark, model, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(60)
    texts = next(text_groups(pa.array([" ".join(r.text or "" for r in docs.collect())])))
    whole, _ = langid.label_words(model, texts)
    monkeypatch.setattr(langid, "CELLS", 4 * 97)
    parts, bounds = langid.label_words(model, texts)
    assert bounds[-1] > 5000
    assert np.allclose(whole, parts)


def test_sample_takes_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 40)
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 100 == 0, F.lit("rare")).otherwise(F.lit("often")).alias("lang"),
    )
    got = sorted(langid.sample(docs, F.lit(True)))
    want = []
    for lang in ("often", "rare"):
        by_hash = docs.filter(F.col("lang") == lang).orderBy(F.xxhash64(F.col("doc_id").cast("string")))
        want += [(lang, r.text) for r in by_hash.limit(40).collect()]
    assert got == sorted(want) and len(got) == 60
    # One id for all rows: its hash is in no small range, and is taken all the same.
    assert len(langid.sample(docs.withColumn("doc_id", F.lit(7)), F.lit(True))) == 60
