"""Store, outbox, JSON lines and newest versions: repeat runs and order."""

import datetime as dt
import random
import re
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rolesift.functions.terms import default_rules
from rolesift.operators.latest import latest
from rolesift.operators.pending import new_postings, unnotified, unreviewed
from rolesift.operators.validate import validate
from rolesift.plans.flows import find_and_score, save_and_review
from rolesift.schema import OUTBOX, POSTING, SCORED
from rolesift.sources.jsonl import read_json, write_json
from rolesift.sources.outbox import read_outbox, write_outbox
from rolesift.sources import commits as commits_module
from rolesift.sources.files import size
from rolesift.sources.store import compact, list_postings, retain, save_postings, versions

DAY = dt.datetime(2024, 1, 1)


def scored(spark, *data):
    """Rows of (posting_id, url, day, score)."""
    return spark.createDataFrame(
        [
            (i, url, f"t{i}", None, None, DAY + dt.timedelta(days=day), score, f"r{score}")
            for i, url, day, score in data
        ],
        SCORED,
    )


def short(df):
    return sorted((r.posting_id, r.url, (r.seen_at - DAY).days, r.score) for r in df.collect())


def brute_force(*batches):
    newest = {}
    for batch in batches:
        for row in batch:
            old = newest.get(row[1])
            if old is None or (row[2], row[0]) >= (old[2], old[0]):
                newest[row[1]] = row
    return sorted(newest.values())


def test_save_keeps_the_newest(spark, tmp_path):
    store = f"{tmp_path}/store"
    first = [(1, "a", 1, 5), (2, "a", 2, 6), (3, "b", 5, 7), (4, "c", 1, 8), (5, "c", 1, 9)]
    second = [(6, "a", 3, 1), (7, "b", 4, 2), (8, "d", 1, 3), (5, "c", 1, 10)]
    assert save_postings(scored(spark, *first), store) == 1
    assert short(list_postings(spark, store)) == brute_force(first)
    assert save_postings(scored(spark, *second), store) == 2
    want = [(3, "b", 5, 7), (5, "c", 1, 10), (6, "a", 3, 1), (8, "d", 1, 3)]
    assert short(list_postings(spark, store)) == want == brute_force(first, second)
    # Saving again changes nothing, and old versions stay readable.
    assert save_postings(scored(spark, *second), store) == 3
    assert short(list_postings(spark, store)) == want
    assert short(list_postings(spark, store, version=1)) == brute_force(first)
    assert short(list_postings(spark, store, F.col("score") > 5)) == [
        (3, "b", 5, 7), (5, "c", 1, 10),
    ]
    assert short(list_postings(spark, store, "url = 'a'")) == [(6, "a", 3, 1)]


def test_random_saves(spark, tmp_path, monkeypatch):
    """Against brute force, with and without broadcasts."""
    rng = random.Random(5)
    number = iter(range(10_000))
    batches = [
        [(next(number), f"u{rng.randrange(40)}", rng.randrange(6), 0) for _ in range(60)]
        for _ in range(4)
    ]
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            store = f"{tmp_path}/store{threshold}"
            for n, batch in enumerate(batches, 1):
                save_postings(scored(spark, *batch), store)
                assert short(list_postings(spark, store)) == brute_force(*batches[:n])
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_half_written_save_is_ignored(spark, tmp_path):
    store = f"{tmp_path}/store"
    save_postings(scored(spark, (1, "a", 1, 5)), store)
    (tmp_path / "store" / "delta-00000002-x").mkdir()
    (tmp_path / "store" / "delta-00000002-x" / "part-0.parquet").write_bytes(b"broken")
    assert versions(spark, store) == [1]
    assert save_postings(scored(spark, (2, "b", 1, 6)), store) == 2
    assert short(list_postings(spark, store)) == [(1, "a", 1, 5), (2, "b", 1, 6)]
    retain(spark, store)
    assert not (tmp_path / "store" / "delta-00000002-x").exists()
    assert short(list_postings(spark, store)) == [(1, "a", 1, 5), (2, "b", 1, 6)]


def test_failed_save_leaves_nothing(spark, tmp_path):
    store = f"{tmp_path}/store"
    save_postings(scored(spark, (1, "a", 1, 5)), store)
    before = sorted(p.name for p in (tmp_path / "store").iterdir())
    broken = scored(spark, (2, "b", 1, 6)).withColumn("title", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        save_postings(broken, store)
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == before
    assert versions(spark, store) == [1]


def interleaved(monkeypatch, *others):
    """Lets others commit between a writer's last look and its own commit."""
    waiting, create = list(others), commits_module.create_text

    def late(spark, path, text):
        if waiting:
            waiting.pop(0)()
        return create(spark, path, text)

    monkeypatch.setattr(commits_module, "create_text", late)


def test_interleaved_saves_both_survive(spark, tmp_path, monkeypatch):
    """Both saw version 1; one commits 2, the other 3, and is the later save."""
    path = f"{tmp_path}/store"
    save_postings(scored(spark, (1, "a", 1, 5)), path)
    interleaved(monkeypatch, lambda: save_postings(scored(spark, (2, "b", 1, 6), (3, "c", 1, 1)), path))
    assert save_postings(scored(spark, (3, "c", 1, 7), (4, "d", 1, 8)), path) == 3
    want = [(1, "a", 1, 5), (2, "b", 1, 6), (3, "c", 1, 7), (4, "d", 1, 8)]
    assert short(list_postings(spark, path)) == want
    assert short(list_postings(spark, path, version=2)) == [(1, "a", 1, 5), (2, "b", 1, 6), (3, "c", 1, 1)]
    assert compact(spark, path) == 4 and short(list_postings(spark, path)) == want


def test_a_save_during_a_compaction_survives(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    save_postings(scored(spark, (1, "a", 1, 5)), path)
    interleaved(monkeypatch, lambda: save_postings(scored(spark, (1, "a", 1, 9), (2, "b", 1, 6)), path))
    assert compact(spark, path) == 3
    assert short(list_postings(spark, path)) == [(1, "a", 1, 9), (2, "b", 1, 6)]
    # Of two compactions one is dropped, with its folder.
    interleaved(monkeypatch, lambda: compact(spark, path))
    assert compact(spark, path) == 4
    assert short(list_postings(spark, path)) == [(1, "a", 1, 9), (2, "b", 1, 6)]
    retain(spark, path)
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("base-")]) == 1
    assert short(list_postings(spark, path)) == [(1, "a", 1, 9), (2, "b", 1, 6)]


def test_saves_from_several_threads(spark, tmp_path):
    """On a file system whose create is exclusive none is lost; a local one tests
    and creates in two steps, so here only what was acknowledged once counts."""
    path = f"{tmp_path}/store"
    batches = [scored(spark, (n, f"u{n}", 1, n), (99, "hot", n, n)) for n in range(4)]
    save_postings(batches[0], path)
    locked, create = threading.Lock(), commits_module.create_text

    def exclusive(*args):
        with locked:
            return create(*args)

    with pytest.MonkeyPatch.context() as m, ThreadPoolExecutor(3) as pool:
        m.setattr(commits_module, "create_text", exclusive)
        made = list(pool.map(lambda df: save_postings(df, path), batches[1:]))
    assert sorted(made) == [2, 3, 4]
    want = [(n, f"u{n}", 1, n) for n in range(4)] + [(99, "hot", 3, 3)]
    assert short(list_postings(spark, path)) == want


def test_listing_some_urls(spark, tmp_path):
    """The same rows as a filter, from a few files of the base."""
    path = f"{tmp_path}/store"
    many = [(n, f"u{n}", 1, n) for n in range(400)]
    save_postings(scored(spark, *many), path)
    compact(spark, path, part_bytes=256)
    save_postings(scored(spark, (5, "u5", 2, 0), (500, "new", 1, 1), (6, "u6", 0, 0)), path)
    save_postings(scored(spark, (500, "new", 2, 2)), path)
    asked = spark.createDataFrame([("u5",), ("u5",), ("u6",), ("new",), ("none",), (None,)], "url string")
    got = list_postings(spark, path, urls=asked)
    assert short(got) == [(5, "u5", 2, 0), (6, "u6", 1, 6), (500, "new", 2, 2)]
    assert got.columns == SCORED.names
    assert short(list_postings(spark, path, "score > 1", urls=asked)) == [(6, "u6", 1, 6), (500, "new", 2, 2)]
    base = [f for f in list_postings(spark, path).inputFiles() if "/base-" in f]
    read = [f for f in got.inputFiles() if "/base-" in f]
    assert len(base) > 16 and len(set(read)) <= 5


def test_a_filter_on_the_url_reaches_every_scan(spark, tmp_path):
    path = f"{tmp_path}/store"
    for n in range(2):
        save_postings(scored(spark, (n, "a", n, n), (n + 5, f"u{n}", n, n)), path)
        if n == 0:
            compact(spark, path)
    text = list_postings(spark, path, "url = 'a'")._jdf.queryExecution().toString()
    scans = re.findall(r"FileScan parquet.*", text)
    assert len(scans) >= 4 and all("EqualTo(url,a)" in s for s in scans)
    for where in ("url = 'a' AND score > 0", "rand() < 2"):
        assert list_postings(spark, path, where).count() == (1 if "url" in where else 3)


def test_a_save_costs_what_the_batch_costs(spark, tmp_path):
    path = f"{tmp_path}/store"
    many = spark.range(20_000).select(
        F.col("id").alias("posting_id"), F.concat(F.lit("u"), "id").alias("url"),
        F.md5(F.col("id").cast("string")).alias("title"), F.lit(DAY).alias("seen_at"),
    )
    save_postings(many.coalesce(2), path)
    first = size(spark, path)
    save_postings(many.filter("posting_id < 20").coalesce(1), path)
    assert size(spark, path) - first < first / 20
    assert list_postings(spark, path).count() == 20_000


def test_compaction_and_retention(spark, tmp_path):
    path = f"{tmp_path}/store"
    first = [(1, "a", 1, 5), (2, "b", 5, 7)]
    second = [(3, "a", 3, 1), (2, "b", 5, 8)]
    third = [(4, "c", 1, 2), (3, "a", 3, 9)]
    save_postings(scored(spark, *first), path)
    save_postings(scored(spark, *second), path)
    want = brute_force(first, second)
    assert short(list_postings(spark, path)) == want
    assert compact(spark, path) == 3 == compact(spark, path)
    assert short(list_postings(spark, path)) == want
    save_postings(scored(spark, *third), path)
    want = brute_force(first, second, third)
    assert short(list_postings(spark, path)) == want
    assert short(list_postings(spark, path, version=1)) == brute_force(first)
    retain(spark, path, newest=2)
    assert versions(spark, path) == [3, 4]
    assert short(list_postings(spark, path)) == want
    assert short(list_postings(spark, path, version=3)) == brute_force(first, second)
    retain(spark, path)
    assert versions(spark, path) == [4]
    assert short(list_postings(spark, path)) == want


def test_empty_store(spark, tmp_path):
    store = f"{tmp_path}/store"
    empty = list_postings(spark, store)
    assert empty.schema == SCORED and empty.count() == 0
    scan = scored(spark, (1, "a", 1, 5))
    assert short(new_postings(scan, empty)) == short(scan)
    with pytest.raises(ValueError):
        save_postings(scan, store)
        list_postings(spark, store, version=9)


def test_postings_without_score(spark, tmp_path):
    store = f"{tmp_path}/store"
    save_postings(scored(spark, (1, "a", 1, 5)).select(*POSTING.names), store)
    assert list_postings(spark, store).first().score is None


def test_pending(spark):
    left = scored(spark, (1, "a", 1, 5), (2, "b", 1, 6), (3, "b", 2, 6), (4, "c", 1, 7))
    done = spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "url string")
    for operator in (new_postings, unnotified, unreviewed):
        assert [r[0] for r in short(operator(left, done))] == [2, 3]


def test_outbox_repeats_nothing(spark, tmp_path):
    path = f"{tmp_path}/outbox"
    strong = scored(spark, (1, "a", 1, 25), (2, "b", 1, 15))
    assert read_outbox(spark, path).schema == OUTBOX
    for _ in range(2):
        write_outbox(unnotified(strong, read_outbox(spark, path)), path)
    assert sorted(r.url for r in read_outbox(spark, path).collect()) == ["a", "b"]


@pytest.mark.parametrize("update", [True, False])
def test_save_and_review_twice(spark, tmp_path, update):
    store = f"{tmp_path}/store"
    reviews = spark.createDataFrame([("b",)], "url string")
    scan = scored(spark, (1, "a", 1, 5), (2, "b", 1, 25), (3, "c", 1, 15), (4, "d", 1, 15))
    for _ in range(2):
        listed = save_and_review(scan, store, reviews, update=update).collect()
        assert [r.url for r in listed] == ["c", "d", "a"]
    top = save_and_review(scan, store, reviews, k=2, update=update).collect()
    assert [r.url for r in top] == ["c", "d"]
    newer = scored(spark, (5, "a", 2, 30), (6, "e", 1, 20))
    listed = save_and_review(newer, store, reviews, update=update).collect()
    assert [r.url for r in listed] == (["a", "e", "c", "d"] if update else ["e", "c", "d", "a"])


def test_the_flow_saves_whole_postings(spark, tmp_path):
    raw = scored(spark, (1, "a", 1, 0), (2, "b", 1, 0)).select(*POSTING.names).withColumns(
        {"description": F.concat(F.lit("about "), "url"), "location": F.lit("Remote")}
    )
    store = f"{tmp_path}/store"
    save_and_review(find_and_score(raw, default_rules(spark)), store, raw.limit(0))
    saved = sorted(list_postings(spark, store).collect())
    assert [(r.url, r.description, r.location, r.score) for r in saved] == [
        ("a", "about a", "Remote", 5), ("b", "about b", "Remote", 5),
    ]


def test_json_round_trip(spark, tmp_path):
    postings = scored(spark, (1, "a\n\"b\"", 1, 5), (2, "é☃", 2, 6)).select(*POSTING.names)
    micros = F.unix_micros("seen_at") + F.col("posting_id") * 123_456
    postings = postings.withColumn("seen_at", F.timestamp_micros(micros))
    write_json(postings, f"{tmp_path}/json")
    got = read_json(spark, f"{tmp_path}/json")
    assert {r.raw_line for r in got.collect()} == {None}
    assert rows(got.drop("raw_line")) == rows(postings)
    assert rows(read_json(spark, f"{tmp_path}/json", raw_line=None)) == rows(postings)


def test_broken_json_line(spark, tmp_path):
    """Validation rejects it and keeps what arrived."""
    good = '{"posting_id": 1, "title": "t", "url": "u", "seen_at": "2024-01-01T00:00:00Z"}'
    (tmp_path / "x.json").write_text(f'{good}\n{{"posting_id": \n{{"posting_id": 2}}\n')
    got = read_json(spark, f"{tmp_path}/x.json")
    valid, rejected = validate(got)
    assert [(r.posting_id, r.seen_at) for r in valid.collect()] == [(1, DAY)]
    assert sorted((r.raw_line or "", r.posting_id or 0) for r in rejected.collect()) == [
        ("", 2), ('{"posting_id": ', 0),
    ]


def test_latest_prefers_time_then_id(spark):
    df = scored(spark, (9, "a", 1, 0), (1, "a", 2, 0), (2, "a", 2, 0), (3, "b", 1, 0))
    assert short(latest(df)) == [(2, "a", 2, 0), (3, "b", 1, 0)]


def test_default_rules_table(spark):
    rules = default_rules(spark)
    assert rules.count() == rules.select("rule_id").distinct().count() == 25
