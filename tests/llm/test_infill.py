"""Fill-in-the-middle against a plain version."""

import hashlib
import re

import pytest
from conftest import rows
from llm_rows import awkward  # noqa: F401
from pyspark.sql import functions as F

from rolesift.llm import infill
from rolesift.llm.infill import Marks, fill_in_middle, restore
from rolesift.llm.queries import op13_fill_in_middle

SF_DIR = "/root/testdata/sf0.01"


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    name = f"1:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(docs):
    made = fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    want = [plainly(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = made.select("doc_id", restore(F.col("output"), F.col("form")).alias("text"))
    assert rows(back) == rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return {r[2] for r in got}


def test_the_test_table(spark):
    assert check(spark.read.parquet(f"{SF_DIR}/documents.parquet")) == {"plain", "psm", "spm"}


def test_awkward_rows(awkward, monkeypatch):
    check(awkward)
    check(awkward.limit(0))
    monkeypatch.setattr(infill, "GROUP_BYTES", 7)
    check(awkward)


def test_texts_that_look_like_marks(spark):
    texts = ["a <P> b", "<S>", "x<M", "<<P", "P>S>M>", "<P<S<M<", "><P", "< P>", "<\n>", "a<Ṕ>"]
    docs = [(k, t + " tail " * (k % 4)) for k, t in enumerate(texts * 20)]
    check(spark.createDataFrame(docs, "doc_id long, text string"))


def test_a_very_long_text(spark):
    body = "wörd 𝒳, <p> 12\n" * 200_000
    check(spark.createDataFrame([(k, body[k:]) for k in range(3)], "doc_id long, text string"))


def test_other_marks_and_shares(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("some words, here").alias("text"))
    marks = Marks("[pre]", "[suf]", "[mid]")
    made = fill_in_middle(docs, marks, plain_percent=0, spm_percent=100, seed=5)
    assert {r.form for r in made.collect()} == {"spm"}
    back = made.select(restore(F.col("output"), F.col("form"), marks).alias("text")).distinct()
    assert [r.text for r in back.collect()] == ["some words, here"]
    for wrong in (("a", "a", "b"), ("", "x", "y"), ("<a<", "<s", "q"), ("ab", "xaby", "z")):
        with pytest.raises(ValueError):
            Marks(*wrong)


def test_query_restores_every_text(spark):
    got = {r.doc_id: r for r in op13_fill_in_middle(spark, SF_DIR).collect()}
    for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        _, n, form, prefix, middle, output = plainly(row.doc_id, row.text)
        found = got[row.doc_id]
        assert (found.n, found.form, found.prefix_chars, found.middle_chars) == (n, form, prefix, middle)
        assert found.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert found.restored_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
