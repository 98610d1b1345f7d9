"""Decontamination against plain Python."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from llm_rows import awkward  # noqa: F401

from rolesift.llm import decontaminate
from rolesift.llm.decontaminate import drop_contaminated, find_contamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((doc_id, len(w), len(hit), len(names), sorted(names), bool(hit)))
    return sorted(out, key=repr)


def found(docs, items):
    got = find_contamination(docs, items).collect()
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got), key=repr
    )


ITEMS = [
    (1, "The quick brown fox, jumps over the lazy dog and then some more words"),
    (2, "short item here"),
    (10, "one"),
    (3, ""),
    (4, None),
    (None, "a null id item of exactly ten words is this one"),
    (5, "short item here"),
    (6, "été ÉTÉ 東京 x1 y2 z3 a4 b5 c6 d7 e8"),
]
DOCS = [
    (1, "xx the QUICK-brown fox jumps over the lazy dog and then yy some more words"),
    (2, "short item here short item here"),
    (3, "Short, item; HERE!"),
    (4, "short item there"),
    (5, None),
    (6, ""),
    (7, "a null id item of exactly ten words is this one one"),
    (8, "été ÉTÉ 東京 x1 y2 z3 a4 b5 c6 d7 e8"),
    (9, "été été 東京 x1 y2 z3 a4 b5 c6 d7 e8"),
    (9, "été été 東京 x1 y2 z3 a4 b5 c6 d7 e8"),
    (11, "the quick brown fox jumps over the lazy dog andthen"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(DOCS, "doc_id long, text string"),
        spark.createDataFrame(ITEMS, "item_id long, text string"),
    )


def test_hand_written(tables):
    assert found(*tables) == plain(DOCS, ITEMS)


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_blocks_and_no_broadcast(spark, tables, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs = [*DOCS, (20, " ".join(t or "" for _, t in DOCS) * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, tables[1]) == plain(docs, ITEMS)
    want = rows(decontaminate.text_hits(df, tables[1]))
    assert rows(decontaminate.text_hits(df, tables[1], most_broadcast_bytes=0)) == want
    monkeypatch.setattr(decontaminate, "MOST_KNOWN", 0)
    assert rows(decontaminate.text_hits(df, tables[1])) == want


def test_awkward_rows(spark, awkward, tables):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward, tables[1]) == plain(docs, ITEMS)
    kept = drop_contaminated(awkward, tables[1])
    assert kept.select("_key", "__text_a", "size", "label").distinct().collect() == [("x",) * 4]
    assert kept.columns == awkward.columns
    clean = sorted(repr((d[0],)) for d in plain(docs, ITEMS) if not d[-1])
    assert sorted(repr((r.doc_id,)) for r in kept.collect()) == clean
    none = tables[1].limit(0)
    assert found(awkward, none) == plain(docs, [])
    assert drop_contaminated(awkward, none).count() == len(docs)
    assert found(awkward.limit(0), tables[1]) == []


def test_no_python(spark, tables):
    plan = find_contamination(*tables)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_hot_copies(spark, tables):
    df = tables[0].withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(300))))
    got = find_contamination(df, tables[1]).groupBy("doc_id", "n_hit").count()
    assert {(r.doc_id, r.n_hit): r["count"] for r in got.collect()} == {
        (i, h): 300 * sum(d[0] == i for d in DOCS) for i, _, h, *_ in plain(DOCS, ITEMS)
    }
