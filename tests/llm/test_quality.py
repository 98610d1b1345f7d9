"""Quality rules against plain Python."""

import random
import re
from collections import Counter

import pytest

from llm_rows import awkward  # noqa: F401

from rolesift.llm import quality
from rolesift.llm.quality import judge
from rolesift.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = Counter(grams)
        return {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for i, x in enumerate(lines) if x in set(lines[:i])] if len(set(lines)) < len(lines) else []
    repeat = len(covered(3))
    shares = [sum(len(words[i]) for i in covered(n)) / max(chars, 1) for n in quality.MOST_REPEATED]
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    kept = (
        not failed
        and all(s <= most for s, most in zip(shares, quality.MOST_REPEATED.values()))
        and len(dup) <= 0.30 * len(lines)
        and sum(map(len, dup)) <= 0.20 * chars
    )
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), chars, symbols, len(lines), len(dup), sum(map(len, dup)), repeat,
            [pytest.approx(s) for s in shares], failed, kept)


def measured(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.dup_line_chars,
            r.n_repeat_words, r.repeated_shares, r.base_failed, r.kept)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op7_repetition"](spark, SF_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        assert measured(r) == plain(docs[r.doc_id])
    assert {r.kept for r in got} == {True, False} == {r.base_failed for r in got}


def test_repetition_of_every_kind(spark):
    rng = random.Random(6)
    words = [f"wörd{i}" for i in range(40)]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            part = " ".join(rng.choices(words, k=rng.randrange(1, 14)))
            parts += [part] * rng.choice([1, 1, 1, 2, 4])
        rng.shuffle(parts)
        texts.append(rng.choice(["\n", " ", "\n\n", " \n"]).join(parts))
    texts += [" ".join(f"clean{k}" for k in range(100)) + f"\n{t}" for t in texts[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: measured(r) for r in judge(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain(text)
    assert len({g[-1] for g in got.values()}) == 2


def test_awkward_rows(spark, awkward):
    want = sorted(repr((r.doc_id, *plain(r.text)[:7], *plain(r.text)[8:])) for r in awkward.collect())
    got = sorted(repr((r.doc_id, *measured(r)[:7], *measured(r)[8:])) for r in judge(awkward).collect())
    assert got == want
    assert judge(awkward.limit(0)).count() == 0


def test_long_words_and_pieces(spark, monkeypatch):
    from rolesift.llm import arrays

    monkeypatch.setattr(arrays, "PIECE_BYTES", 64)
    monkeypatch.setattr(arrays, "GROUP_BYTES", 256)
    text = "x" * 300 + " a b c " * 40 + "\n" + "y" * 70 + "\n" + "x" * 300
    df = spark.createDataFrame([(1, text), (2, text * 3), (3, "")], "doc_id long, text string")
    got = {r.doc_id: measured(r) for r in judge(df).collect()}
    assert got == {1: plain(text), 2: plain(text * 3), 3: plain("")}
