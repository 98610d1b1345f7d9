"""The Pitman-Yor model: counts, normalisation, seating, held-out perplexity."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from llm_rows import awkward  # noqa: F401

from rolesift.llm import pitman_yor
from rolesift.llm.arrays import mix, text_groups, words_of
from rolesift.llm.blocks import pack, unpack
from rolesift.llm.pitman_yor import perplexity, score_documents, seat
from rolesift.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF_DIR = "/root/testdata/sf0.01"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def counts(docs):
    """(doc_id, held, tokens, known, N, base score) of each row."""
    seen = Counter()
    for i, text in docs:
        if not held(i):
            seen.update(tokens(text))
    n, v = sum(seen.values()), len(seen)
    return [
        (i, held(i), len(t), sum(seen[w] > 0 for w in t), n,
         sum(math.log10((seen[w] + 1) / (n + 1 * (v + 1))) for w in t))
        for i, t in ((i, tokens(text)) for i, text in docs)
    ]


def check(got, docs):
    key = lambda r: repr(r[:5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                  for r in got), key=key)
    want = sorted(counts(docs), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def test_counts_and_better_than_its_base(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scored = QUERIES["op4_pitman_yor"](spark, SF_DIR).cache()
    check(scored.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    by = {r.held_out: r for r in perplexity(scored).collect()}
    assert by[True].perplexity < 0.25 * by[True].base_perplexity
    assert by[False].perplexity < by[True].perplexity
    assert scored.filter("score > 0 or score is null or isnan(score)").count() == 0


def test_reruns_agree(spark):
    sf = "/root/testdata/sf0.001"
    first = rows(QUERIES["op4_pitman_yor"](spark, sf))
    assert first == rows(QUERIES["op4_pitman_yor"](spark, sf))


def test_normalised_per_context():
    """The answers to a bucket that holds everything sum to one in each context."""
    rng = np.random.default_rng(0)
    n_words, contexts = 30, pitman_yor.CONTEXTS
    word = np.repeat(np.arange(n_words + 1), 3)  # the last word is never trained
    context = np.tile([0, 5, contexts], n_words + 1)
    counts_ = np.where(word < n_words, rng.integers(0, 9, len(word)), 0)
    counts_[::3] = np.where(word[::3] < n_words, np.maximum(counts_[::3], 1), 0)
    by_context = np.bincount(context, counts_, contexts + 1)
    corpus = pitman_yor.Corpus(by_context, np.bincount(context[counts_ > 0], minlength=contexts + 1),
                               n_words, 0.3, 0.6, 0.4, 1)
    batch = pa.RecordBatch.from_pylist([{
        "bucket": 0, "word": pack(word.astype(np.int32)), "context": pack(context.astype(np.uint16)),
        "counts": pack(counts_.astype(np.int64)), "blocks": ["b"],
        "places": [pitman_yor._pack_sorted(np.arange(len(word), dtype=np.int32))],
    }])
    seated = list(pitman_yor._sampled(corpus, 1)([batch]))[0].to_pylist()[0]
    totals = np.array(seated["sums"], dtype=float)
    full = {**batch.to_pylist()[0], "seats": seated["seats"], "root_seats": seated["root_seats"]}
    reply = list(pitman_yor._answers(corpus, totals)([pa.RecordBatch.from_pylist([full])]))[0]
    p = 10 ** unpack(reply.to_pylist()[0]["scores"]).astype(float)
    sums = np.bincount(context, p, contexts + 1)[[0, 5, contexts]]
    assert np.allclose(sums, 1, atol=1e-5)


def test_seating_follows_the_process():
    """Mean tables of a Pitman-Yor restaurant with one dish and a flat parent."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 10, 400):
        got = seat(np.full(20_000, n), np.full(20_000, 0.5), 0.5, rng).mean()
        mean = 1.0
        total = np.zeros(n + 2)
        total[1] = 1
        for k in range(1, n):
            t = np.arange(n + 2)
            new = 0.5 / (0.5 + np.maximum(k - 0.5 * t, 1e-12))
            step = total * (1 - new)
            step[1:] += (total * new)[:-1]
            total = step
        mean = (total * np.arange(n + 2)).sum()
        assert got == pytest.approx(mean, rel=0.05)
    assert seat(np.zeros(3, dtype=int), np.ones(3), 0.5, rng).tolist() == [0, 0, 0]


def test_awkward_rows(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    got = score_documents(awkward).collect()
    check(got, docs)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert score_documents(awkward.limit(0)).count() == 0


def test_nothing_to_learn_from(spark, awkward):
    got = score_documents(awkward, held=F.lit(True)).collect()
    assert len(got) == awkward.count()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in got)


def test_a_word_that_holds_a_third_of_all_tokens(spark):
    texts = ["the " * 400 + " ".join(f"w{i}x{k}" for k in range(300)) for i in range(40)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = score_documents(df).collect()
    check(got, docs)
    assert all(r.score > r.base_score for r in got)


def test_every_context_has_its_own_followers(spark):
    """Words that were hashed to one of 4096 restaurants do not share followers,
    and what is known of a context comes from all buckets of words."""
    names = [f"c{i}" for i in range(400)]
    hashes = words_of(next(text_groups(pa.array([" ".join(names)]))), lower=True).hashes
    places = mix(hashes) % np.uint64(4096)
    first = {}
    rare, often = next((name, first[p]) for name, p in zip(names, places.tolist(), strict=True)
                       if first.setdefault(p, name) != name)
    other = next(n for n, p in zip(names, places.tolist(), strict=True)
                 if p != places[names.index(rare)])
    texts = [f"{often} likely"] * 300 + [f"z {rare} y z {other} y"]
    asked = [f"z {rare} likely", f"z {other} likely", f"z {rare}", f"z {other}"]
    docs = spark.createDataFrame(list(enumerate(texts + asked)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in
           score_documents(docs, held=F.col("doc_id") >= len(texts)).collect()}
    scores = [got[len(texts) + k] for k in range(len(asked))]
    assert scores[0] == pytest.approx(scores[1], abs=0.05)
    assert scores[2] == pytest.approx(scores[3], abs=0.05)


def test_all_texts_together_have_probability_one(spark):
    """Over a few words and one unknown one, from the scores of the empty text and
    of all texts of one and two words: longer ones follow, as each word depends on
    the one before only."""
    rng = np.random.default_rng(3)
    known = ["a", "b", "c", "d", "e"]
    taught = [" ".join(rng.choice(known, rng.integers(0, 9), p=[0.5, 0.2, 0.15, 0.1, 0.05])) for _ in range(200)]
    words = [*known, "unknown"]
    asked = ["", *words, *(f"{v} {w}" for v in words for w in words)]
    docs = spark.createDataFrame(list(enumerate(taught + asked)), "doc_id long, text string")
    scored = score_documents(docs, held=F.col("doc_id") >= len(taught))
    rows_ = scored.filter("held_out").orderBy("doc_id").collect()
    p = 10 ** np.array([r.score for r in rows_])
    n = len(words)
    one, two = p[1 : n + 1], p[n + 1 :].reshape(n, n)
    longer = np.linalg.solve(np.eye(n) - two / one, one)
    assert p[0] + longer.sum() == pytest.approx(1, abs=1e-4)


def test_the_number_of_buckets_hardly_matters(spark, monkeypatch):
    """Buckets guess the corpus' totals during the sweeps."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = []
    for n in (1, 40):
        monkeypatch.setattr(pitman_yor, "bucket_count", lambda *_, n=n: n)
        found.append({r.held_out: r.perplexity for r in perplexity(score_documents(docs)).collect()})
    for key in (True, False):
        assert found[0][key] == pytest.approx(found[1][key], rel=0.01)
