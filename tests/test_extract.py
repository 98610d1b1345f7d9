"""Page text and fields on small hand-written pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolesift.functions.text import decode_entities
from rolesift.operators.extract import page_fields, page_location, page_text, postings_from_pages
from rolesift.operators.validate import validate
from rolesift.schema import PAGE

TEXTS = {
    "<p>One</p><p>two</p>": "One two",
    "a<script>var x = '</p><h1>no</h1>';</script>b": "a b",
    "a<SCRIPT type='x'>no</SCRIPT >b<style>p{}</style>c": "a b c",
    "a<!-- <p>no</p> -->b<!-- <script> -->c": "a b c",
    "<scripture>yes</scripture>": "yes",
    "x < y and y > z": "x < y and y > z",
    "end <script>never closed": "end",
    "end <!-- never closed": "end",
    "end <a href='never closed": "end",
    "<!DOCTYPE html><?xml version='1'?>ok": "ok",
    "A&amp;B &lt;b&gt; &amp;lt; &quot;q&quot; &#39;s&#x27;": "A&B <b> &lt; \"q\" 's'",
    " \n\t many&nbsp;&nbsp; blanks ": "many blanks",
    "plain": "plain",
    "": "",
    None: None,
}

ENTITIES = {
    "&eacute;&Eacute;&euro;&hellip;&mdash;": "éÉ€…—",
    "&#8217;&#x2019;&#128512;&apos;": "’’😀'",
    "&#0;&#xD800;&#9999999;": "���",
    "&unknown; & &; &#; &amp": "&unknown; & &; &#; &amp",
    "AT&T": "AT&T",
    "&&amp;": "&&",
}


@pytest.fixture(scope="module")
def pages(spark):
    data = [
        (1, "https://www.Example.com:8080/a?b#c", "<html lang='EN-us'><title> A &amp; B </title>"
            "<script>'<h1>no</h1>'</script><h1 class=x>The <b>job</b></h1></html>"),
        (2, "http://user@host.example/x", "<html><body><H1>Only a heading</H1></body></html>"),
        (3, "not a url", "<title>Only a title</title>"),
        (4, None, None),
        (5, "https://e.example", '<html class="x" lang=de><title>never closed'),
    ]
    return spark.createDataFrame(data, PAGE)


def test_text(spark):
    df = spark.createDataFrame([(h,) for h in TEXTS], "html string")
    assert {r.html: r.text for r in page_text(df).collect()} == TEXTS


def test_long_text_is_whole(spark):
    body = "word " * 200_000
    df = spark.createDataFrame([(f"<p>{body}</p><script>{body}</script>end",)], "html string")
    assert page_text(df).first().text == body + "end"


def test_entities(spark):
    df = spark.createDataFrame([(t,) for t in ENTITIES], "t string")
    got = {r.t: r.d for r in df.withColumn("d", decode_entities(F.col("t"))).collect()}
    assert got == ENTITIES


def test_fields(pages):
    got = {r.page_id: (r.title, r.h1, r.lang, r.host) for r in page_fields(pages).collect()}
    assert got == {
        1: ("A & B", "The job", "en-us", "www.example.com"),
        2: ("", "Only a heading", "", "host.example"),
        3: ("Only a title", "", "", ""),
        4: (None, None, None, ""),
        5: ("never closed", "", "de", "e.example"),
    }


def test_postings_from_pages(pages):
    seen_at = dt.datetime(2024, 1, 1)
    postings = postings_from_pages(pages, F.lit(seen_at), F.lit("Remote"))
    valid, rejected = validate(postings)
    assert {(r.posting_id, r.title, r.location, r.seen_at) for r in valid.collect()} == {
        (1, "The job", "Remote", seen_at),
        (2, "Only a heading", "Remote", seen_at),
        (3, "Only a title", "Remote", seen_at),
        (5, "never closed", "Remote", seen_at),
    }
    assert [r.reject_reason for r in rejected.collect()] == ["no_title,no_url"]


PLACES = [
    ("<p>Location: " + "a long way down the river " * 20 + "in Rochester, Minnesota. More.</p>",
     "a long way down the river " * 20 + "in Rochester, Minnesota"),
    ("<p>Location: St. Paul. Remote.</p>", "St. Paul"),
    ("<p>Location: Boston</p><p>Remote is fine</p>", "Boston, remote"),
    ("<p>LOCATION: Boston</p><p>Dallas</p>", "Boston"),
    ("<td>Location</td>\n<td> Twin\nCities </td><td>Java</td>", "Twin Cities"),
    ("<b>Location</b>: <a>Roch&eacute;</a> (north) | x", "Roché (north)"),
    ("<p>Location:</p>", None),
    ("<p>Our location in Minnesota</p>", "minnesota"),
    ("<p>Relocation: paid</p>", None),
    ("<p>Hybrid, near Rochester, New York</p>", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("case", range(len(PLACES)))
def test_page_location(spark, case):
    html, want = PLACES[case]
    page = spark.createDataFrame([(1, "u", html)], PAGE)
    assert page.select(page_location(F.col("html")).alias("p")).first().p == want
    assert postings_from_pages(page, F.current_timestamp()).first().location == want


def test_page_location_of_long_pages(spark):
    """Time is linear in the text, and nothing recurses into it."""
    for body in ("Location " * 100_000, "Location: St. " * 100_000, "<p>Location</p>" * 100_000,
                 "Location: " + "x, " * 500_000):
        page = spark.createDataFrame([(1, "u", f"<p>{body}</p>")], PAGE)
        assert page.select(F.length(page_location(F.col("html"))).alias("n")).collect()


def test_landing_time(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages")
    landed = spark.read.schema(PAGE).parquet(f"{tmp_path}/pages")
    assert postings_from_pages(landed).filter("seen_at IS NULL").count() == 0
