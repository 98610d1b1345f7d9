"""Removed passages against brute force over every string of 400 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm_rows import awkward  # noqa: F401

from rolesift.llm import passages
from rolesift.llm.passages import LENGTH, find_repeats
from rolesift.llm.queries import QUERIES


def brute_force(docs):
    seen = Counter()
    for _, text in docs:
        b = (text or "").encode()
        seen.update(b[i : i + LENGTH] for i in range(len(b) - LENGTH + 1))
    out = []
    for doc_id, text in docs:
        b = (text or "").encode()
        mask = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                mask[i : i + LENGTH] = True
        kept = bytes(c for c, m in zip(b, mask) if not m)
        spans = int((mask[1:] & ~mask[:-1]).sum() + mask[0])
        out.append((doc_id, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    got = find_repeats(df, **options).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr)


def noise(rng, n, letters="abcdefgh \n"):
    return "".join(rng.choices(letters, k=n))


def corpus(seed, n=120):
    rng = random.Random(seed)
    shared = [noise(rng, rng.choice([399, 400, 401, 460, 900, 2500])) for _ in range(10)]
    parts = [
        lambda: noise(rng, rng.randrange(60)),
        lambda: rng.choice(shared),
        lambda: rng.choice(shared)[rng.randrange(300):],
        lambda: rng.choice(shared)[: rng.randrange(350, 460)],
        lambda: "a" * rng.choice([0, 399, 400, 401, 800]),
        lambda: "ab" * rng.choice([0, 190, 200, 400]),
        lambda: "é" * rng.choice([100, 200, 201]),
    ]
    return [(i, "".join(rng.choice(parts)() for _ in range(rng.randrange(7)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    want = brute_force(docs)
    assert 0 < sum(r[2] > 0 for r in want) < len(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(seed)
    assert found(df) == want


def test_joined_by_key(spark):
    """Without broadcasts, and in many small blocks."""
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    assert found(df, most_broadcast_bytes=0) == brute_force(docs)


def test_changed_copies(spark):
    """Copies with single bytes changed: every edge is exact."""
    rng = random.Random(7)
    origin = noise(rng, 3000, "abcdefghijklmnopqrstuvwxyz ")
    docs = [(0, origin)]
    for i in range(1, 40):
        copy = list(origin)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(3000)] = "#"
        docs.append((i, "".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert found(df) == brute_force(docs)


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(passages, "PIECE_BYTES", 8192)
    docs = [(i, (t + noise(random.Random(i), 3000)) * 3) for i, t in corpus(8, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df) == brute_force(docs)


def test_awkward_rows(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward) == brute_force(docs)
    assert found(awkward.limit(0)) == []
    once = spark.createDataFrame([(1, "x" * 10)], "doc_id long, text string")
    assert found(once) == brute_force([(1, "x" * 10)])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op8_passages"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_force(docs)


def test_every_string_has_its_anchor():
    """Equal strings have their anchor at the same place in them."""
    rng = random.Random(9)
    inner = noise(rng, LENGTH).encode()
    places = set()
    for k in range(50):
        data = noise(rng, rng.randrange(500, 900)).encode() + inner + noise(rng, 700).encode()
        start = data.index(inner)
        array = np.frombuffer(data, np.uint8)
        got = passages.anchors(array, np.array([0, len(data)]))
        mine = (got["low"] <= start) & (start <= got["high"])
        assert mine.sum() == 1
        places.add(int(got["shared"][mine][0]))
    assert len(places) == 1
