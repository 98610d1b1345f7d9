"""Scheduled scans: overlapping runs, an empty run, replays."""

import datetime as dt
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rolesift.functions.terms import default_rules
from rolesift.operators.review import strong_fits
from rolesift.operators.validate import validate
from rolesift.plans import registry
from rolesift.plans.flows import find_and_score
from rolesift.plans.postings_fx import postings_fx
from rolesift.schema import OUTBOX, PAGE, POSTING
from rolesift.sources.outbox import read_outbox
from rolesift.streaming import first_seen as first_seen_module
from rolesift.streaming import notify as notify_module
from rolesift.streaming.by_state import put_aside_late, read_late, run_first_seen_by_state
from rolesift.streaming.first_seen import (
    first_seen,
    keep_first_seen,
    read_first_seen,
    run_first_seen,
)
from rolesift.streaming.notify import notify_batch, notify_stream
from rolesift.streaming.scan import run_scan, scan_stream
from rolesift.streaming.watch import watch_pages

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.schema(PAGE).parquet(f"{SF_DIR}/pages.parquet").cache()


def test_scan_takes_each_file_once(spark, pages, tmp_path):
    landing, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("landing", "sink", "checkpoint"))
    seen = []
    for step in (pages.filter("page_id < 20"), pages.filter("page_id >= 20"), None):
        if step is not None:
            step.write.mode("append").parquet(landing)
        run_scan(scan_stream(spark, landing), sink, checkpoint)
        seen.append(spark.read.schema(PAGE).parquet(sink).count())
    assert seen == [20, 50, 50]
    assert rows(spark.read.schema(PAGE).parquet(sink)) == rows(pages)


@pytest.mark.parametrize("max_files", [None, 1])
def test_first_seen_over_overlapping_scans(spark, pages, tmp_path, max_files):
    landing, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("landing", "sink", "checkpoint"))
    seen = []
    for step in (pages.filter("page_id < 30"), pages.filter("page_id >= 10"), None):
        if step is not None:
            step.repartition(2).write.mode("append").parquet(landing)
        run_first_seen(scan_stream(spark, landing, max_files=max_files), sink, checkpoint)
        seen.append(read_first_seen(spark, sink, PAGE).count())
    assert seen == [30, 50, 50]
    assert rows(read_first_seen(spark, sink, PAGE)) == rows(pages)


def sightings(spark, *rows_):
    df = spark.createDataFrame(list(rows_), "url string, seen_at string")
    return validate(df.withColumns({"posting_id": F.lit(1), "title": F.lit("t")}))[0]


def test_first_seen_within_a_period(spark, tmp_path):
    """A url is new once in each period, in whatever order its rows arrive."""
    sink = f"{tmp_path}/sink"

    def run(*rows_):
        keep_first_seen(sightings(spark, *rows_), sink, days=10)
        got = read_first_seen(spark, sink, POSTING).collect()
        return sorted((r.url, str(r.seen_at.date())) for r in got)

    first = [("a", "2024-01-01")]
    assert run(("a", "2024-01-01"), ("a", "2024-01-01")) == first
    assert run(("a", "2024-01-05")) == first
    assert run(("b", "2024-06-01")) == [*first, ("b", "2024-06-01")]
    assert run(("a", "2024-06-02")) == [*first, ("a", "2024-06-02"), ("b", "2024-06-01")]
    # A row that comes late is not lost, whether its url is new or not.
    got = run(("c", "2024-01-01"), ("b", "2023-01-01"))
    assert got == [*first, ("a", "2024-06-02"), ("b", "2023-01-01"), ("b", "2024-06-01"),
                   ("c", "2024-01-01")]
    assert run(("c", "2024-01-01"), ("b", "2023-01-01")) == got


def test_first_seen_of_a_batch(spark):
    df = sightings(spark, ("a", "2024-01-02"), ("a", "2024-01-01"), ("b", "2024-01-01"))
    assert [(r.url, str(r.seen_at.date())) for r in sorted(first_seen(df).collect())] != []
    got = {r.url: str(r.seen_at.date()) for r in first_seen(df).collect()}
    assert got == {"a": "2024-01-01", "b": "2024-01-01"}
    seen = spark.createDataFrame([("a", 0)], "url string, seen_period long")
    assert [r.url for r in first_seen(df, seen).collect()] == ["b"]
    assert first_seen(df.limit(0)).count() == 0


def test_batches_that_fail_leave_no_staged_rows(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    for module in (first_seen_module, notify_module):
        monkeypatch.setattr(module, "shared_dir", lambda _, name: f"{shared}/{name}")
    broken = sightings(spark, ("a", "2024-01-02")).withColumn("title", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        keep_first_seen(broken, f"{tmp_path}/sink")
    with pytest.raises(Exception, match="no"):
        notify_batch(broken, default_rules(spark), f"{tmp_path}/outbox")
    assert not any(shared.rglob("*.parquet")) and not any(shared.glob("*"))


def test_late_sighting_is_not_notified(spark, tmp_path):
    """A strong sighting that lands after a newer weak one."""
    outbox, known = f"{tmp_path}/outbox", f"{tmp_path}/known"

    def post(title, day, location="Remote"):
        return spark.createDataFrame(
            [(1, "u", title, location, None, f"2024-01-{day:02d}")],
            "posting_id long, url string, title string, location string, description string, "
            "seen_at string",
        )

    rules = default_rules(spark)
    notify_batch(post("Senior Manager", 9), rules, outbox, sightings=known)
    notify_batch(post("Java Developer", 5), rules, outbox, sightings=known)
    assert read_outbox(spark, outbox).count() == 0
    notify_batch(post("Java Developer", 10), rules, outbox, sightings=known)
    assert read_outbox(spark, outbox).count() == 1


def test_watch_pages_from_landing_to_outbox(spark, tmp_path):
    """Strong fits of pages, found by the default location, each url once."""
    names = ("landing", "seen", "outbox", "checkpoint")
    landing, seen, outbox, checkpoint = (f"{tmp_path}/{n}" for n in names)

    def page(number, title, body):
        html = f"<html><title>x</title><h1>{title}</h1><p>{body}</p></html>"
        return number, f"https://x.example/{number}", html

    scans = [
        [page(1, "Java Developer", "Location: Rochester, MN. Join us."),
         page(2, "Java Developer", "Location: London. Hybrid."),
         page(3, "Sr. Java Developer", "Remote.")],
        [page(1, "Java Developer", "Location: Rochester, MN. Join us."),
         page(4, "Full-Stack Developer", "This job is remote."),
         page(5, "Unpaid Frontend Developer", "Remote")],
        None,
    ]
    sent = []
    for scan in scans:
        if scan:
            spark.createDataFrame(scan, PAGE).coalesce(1).write.mode("append").parquet(landing)
        watch_pages(
            spark, landing, default_rules(spark), seen, outbox, checkpoint
        ).awaitTermination()
        sent.append(sorted(r.url[-1] for r in read_outbox(spark, outbox).collect()))
    assert sent == [["1"], ["1", "4"], ["1", "4"]]


def test_notify_adds_each_url_once(spark, tmp_path):
    """Two overlapping halves, then nothing new, then a replayed batch."""
    landing, outbox, checkpoint = (f"{tmp_path}/{n}" for n in ("landing", "outbox", "checkpoint"))
    postings, _ = validate(postings_fx(spark, SF_DIR))
    rules = default_rules(spark)
    customer = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    for step in (postings.filter(customer < 100), postings.filter(customer >= 50), None):
        if step is not None:
            step.write.mode("append").parquet(landing)
        notify_stream(
            scan_stream(spark, landing, POSTING), rules, outbox, checkpoint
        ).awaitTermination()
    want = rows(strong_fits(find_and_score(postings, rules)).select(*OUTBOX.names))
    assert len(want) == 36
    assert rows(read_outbox(spark, outbox)) == want
    notify_batch(postings, rules, outbox)
    assert rows(read_outbox(spark, outbox)) == want


def dated(spark, *rows_):
    schema = "url string, seen_at timestamp"
    return spark.createDataFrame(
        [(u, None if d is None else dt.datetime.fromisoformat(d)) for u, d in rows_], schema
    )


def test_first_seen_by_state(spark, tmp_path):
    """Each url once, over runs; the state holds them all."""
    landing, sink, work = f"{tmp_path}/landing", f"{tmp_path}/sink", f"{tmp_path}/work"
    schema, state = dated(spark).schema, []
    for scan in ([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-02")],
                 [("b", "2024-03-01"), ("c", "2023-01-01")], None):
        if scan:
            dated(spark, *scan).coalesce(1).write.mode("append").parquet(landing)
        counts = run_first_seen_by_state(scan_stream(spark, landing, schema), sink, work)
        state.append((counts.rows, counts.in_state or None))
    assert state[:2] == [(3, 2), (2, 3)] and state[2][0] == 0
    assert sorted(r.url for r in spark.read.schema(schema).parquet(sink).collect()) == ["a", "b", "c"]


def test_first_seen_by_bounded_state(spark, tmp_path):
    """Late rows are put aside and counted; Spark itself drops none; urls go out
    of the state when the watermark has passed them."""
    landing, sink, work = f"{tmp_path}/landing", f"{tmp_path}/sink", f"{tmp_path}/work"
    schema = dated(spark).schema
    scans = [
        [("a", "2024-01-01"), ("b", "2024-01-20")],
        [("a", "2024-01-18"), ("old", "2024-01-10"), ("none", None), ("c", "2024-03-01")],
        [("b", "2024-02-25"), ("d", "2024-03-02"), ("older", "2023-01-01"), ("c", "2024-02-20")],
        [("a", "2024-03-03")],
    ]
    late, dropped, state = [], 0, []
    for scan in scans:
        dated(spark, *scan).coalesce(1).write.mode("append").parquet(landing)
        counts = run_first_seen_by_state(scan_stream(spark, landing, schema), sink, work, "10 days")
        late.append(counts.late)
        dropped += counts.dropped
        state.append(counts.in_state)
        assert counts.rows == len(scan)
    assert late == [0, 2, 1 + 1, 0] and dropped == 0
    assert sorted(r.url for r in read_late(spark, f"{sink}-routed", schema).collect()) == [
        "c", "none", "old", "older"]
    got = sorted(r.url for r in spark.read.schema(schema).parquet(sink).collect())
    # a and b come again, a long time after their first sightings.
    assert set(got) == {"a", "b", "c", "d"} and got.count("c") == got.count("d") == 1
    assert got.count("a") >= 2 and got.count("b") == 2
    assert max(state) <= 4


def test_a_replayed_batch_is_routed_alike(spark, tmp_path):
    landing, routed = f"{tmp_path}/landing", f"{tmp_path}/routed"
    schema = dated(spark).schema
    dated(spark, ("a", "2024-01-30")).coalesce(1).write.parquet(landing)
    dated(spark, ("b", "2024-01-01"), ("c", "2024-01-29")).coalesce(1).write.mode("append").parquet(landing)
    for checkpoint in ("one", "two"):  # a new checkpoint takes every file again
        put_aside_late(
            scan_stream(spark, landing, schema, max_files=1), routed, f"{tmp_path}/{checkpoint}", "5 days"
        ).awaitTermination()
        assert [r.url for r in read_late(spark, routed, schema).collect()] == ["b"]


def test_late_rows_are_put_aside_without_a_sort(spark, tmp_path):
    """A task holds none of its rows back, so a large file needs no memory."""
    landing, routed = f"{tmp_path}/landing", f"{tmp_path}/routed"
    schema = dated(spark).schema
    for scan in ([("a", "2024-01-30")], [("b", "2024-01-01"), ("c", "2024-01-29"), ("n", None)]):
        dated(spark, *scan).coalesce(1).write.mode("append").parquet(landing)
        put_aside_late(
            scan_stream(spark, landing, schema), routed, f"{tmp_path}/work", "5 days"
        ).awaitTermination()
    assert sorted(r.url for r in read_late(spark, routed, schema).collect()) == ["b", "n"]
    there = spark.read.parquet(f"{routed}/batch-*/is_late=false")
    assert sorted(r.url for r in there.collect()) == ["a", "c"]
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [ran.apply(k).physicalPlanDescription() for k in range(ran.size())]
    writes = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and routed in p]
    assert writes and not any("Sort" in p for p in writes)


def test_processed_files_leave_the_landing_folder(spark, tmp_path):
    landing, archive = tmp_path / "landing", tmp_path / "archive"
    schema = dated(spark).schema

    def run():
        run_scan(
            scan_stream(spark, str(landing), schema, archive=str(archive)),
            f"{tmp_path}/sink", f"{tmp_path}/work",
        )

    for k in range(3):
        dated(spark, (f"u{k}", "2024-01-01")).coalesce(1).write.mode("append").parquet(str(landing))
        run()
        # The files of the run before have been moved by the time that it ends.
        assert len(list(landing.glob("*.parquet"))) <= 2
    assert len(list(archive.rglob("*.parquet"))) >= 1
    there = spark.read.schema(schema).parquet(f"{tmp_path}/sink")
    assert sorted(r.url for r in there.collect()) == ["u0", "u1", "u2"]


@pytest.mark.parametrize(
    "name, scans",
    [
        ("first_seen", 4),
        ("first_seen_within", 4),
        ("late_sightings", 4),
        ("notify_stream", 4),
        ("watch_pages", 2),
    ],
)
def test_a_scan_lands_in_many_files_and_is_one_batch(spark, tmp_path, monkeypatch, name, scans):
    """A batch of one file is one task's work, however many rows it has."""
    table = "pages" if name == "watch_pages" else "orders"
    source, work = f"{tmp_path}/sf", f"{tmp_path}/work"
    whole = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
    whole.repartition(6).write.parquet(f"{source}/{table}.parquet")
    want = rows(registry.QUERIES[name](spark, SF_DIR))
    monkeypatch.setattr(registry, "shared_dir", lambda *_: work)
    assert rows(registry.QUERIES[name](spark, source)) == want
    landed = [n for n in os.listdir(f"{work}/landing") if n.startswith("part-")]
    assert len(landed) >= 4 * scans
    batches = [n for n in os.listdir(f"{work}/checkpoint/commits") if n.isdigit()]
    assert len(batches) == scans


@pytest.mark.parametrize("name", ["first_seen_within"])
def test_a_scan_of_one_row_group_lands_in_many_files(spark, tmp_path, monkeypatch, name):
    """A table of one file and one row group is landed by one task, and yet the
    batch is not one task's work."""
    source, work = f"{tmp_path}/sf", f"{tmp_path}/work"
    whole = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    whole.coalesce(1).write.parquet(f"{source}/orders.parquet")
    want = rows(registry.QUERIES[name](spark, SF_DIR))
    monkeypatch.setattr(registry, "shared_dir", lambda *_: work)
    monkeypatch.setattr(registry, "SCAN_ROWS", whole.count() // 12, raising=False)
    assert rows(registry.QUERIES[name](spark, source)) == want
    landed = spark.read.parquet(f"{work}/landing").groupBy(F.input_file_name()).count()
    sizes = [r["count"] for r in landed.collect()]
    assert len(sizes) >= 4 * 4 and max(sizes) <= registry.SCAN_ROWS
    batches = [n for n in os.listdir(f"{work}/checkpoint/commits") if n.isdigit()]
    assert len(batches) == 4
