"""Hand-written postings: classes, flags, years, rules, score, validation."""

import datetime as dt
import itertools
import random
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rolesift.functions.terms import DEFAULT_RULES, default_rules
from rolesift.functions.text import holds, lowered, normalised
from rolesift.operators import classify, match
from rolesift.operators.extract import page_fields, page_text
from rolesift.operators.validate import check_postings, validate
from rolesift.schema import CONDITIONAL_RULE, POSTING, RULE

SEEN = dt.datetime(2024, 5, 1, 12)

# title, location, description, expected score, expected rules
CASES = [
    ("Junior Software Engineer", "Remote", "Join us.", 15, "loc_remote,role_junior"),
    ("New Grad Software Engineer", "Austin", None, 10, "role_newgrad"),
    ("Entry-Level Software Developer", None, "", 10, "role_entry"),
    ("Application  Developer", "hybrid", "x", 15, "loc_hybrid,role_app"),
    ("FRONTEND DEVELOPER!", "", "x", 10, "role_fe"),
    ("Full stack Developer", "", "x", 10, "role_fs"),
    ("full-stack developer", "", "x", 10, "role_fs"),
    ("Full-Stack Developer", "", "x", 10, "role_fs"),
    ("Fullstack Developer", "", "x", 10, "role_fs"),
    ("Front-End Engineer", "", "x", 10, "role_fe"),
    ("Sr. Java Developer", "Remote", "x", -5, "loc_remote,pen_senior,role_java"),
    ("Unpaid Frontend Developer", "Remote", "x", -5, "loc_remote,pen_unpaid,role_fe"),
    ("Java Developer (Contract Only)", "Remote", "x", -5, "loc_remote,pen_contract,role_java"),
    ("Clerk", "Hybrid - London", "x", 0, ""),
    ("Clerk", "Hybrid, St. Paul", "x", 5, "loc_hybrid,loc_tc"),
    ("Clerk", "Rochester, New York", "x", 0, ""),
    ("Clerk", "Hybrid - Rochester, NY", "x", 0, ""),
    ("Clerk", "Rochester, NY or Rochester, MN", "x", 5, "loc_mn,loc_roc"),
    ("Clerk", "", "Unpaid parental leave.", 0, ""),
    ("Clerk", "", "Unpaid leave, unpaid work.", -20, "pen_unpaid"),
    ("Clerk", "", "five (5) years", -20, "pen_years"),
    ("Clerk", "", "99999999999 years", -20, "pen_years"),
    ("Java Developer", "", "x", 10, "role_java"),
    ("JavaScript Developer", "", "x", 0, ""),
    ("React / TypeScript Developer", "", "x", 10, "role_react,role_ts"),
    ("Junior AWS Engineer", "", "x", 10, "role_aws"),
    ("Junior Cloud Engineer", "", "x", 10, "role_cloud"),
    ("Clerk", "Rochester, Minnesota", "x", 5, "loc_mn,loc_roc"),
    ("Clerk", "Hybrid - Twin Cities", "x", 5, "loc_hybrid,loc_tc"),
    ("Clerk", "Minnesotan", "x", 0, ""),
    ("Senior Java Developer", "Remote", "x", -5, "loc_remote,pen_senior,role_java"),
    ("Señior Engineer", "", "x", 0, ""),
    ("Staff Engineer", "", "x", -20, "pen_staff"),
    ("Principal Engineer", "", "x", -20, "pen_principal"),
    ("Tech Lead", "", "x", -20, "pen_lead"),
    ("Cloud Architect", "", "x", -20, "pen_arch"),
    ("Engineering Manager", "", "x", -20, "pen_mgr"),
    ("Senior Lead", "", "x", -40, "pen_lead,pen_senior"),
    ("Clerk", "", "You lead a staff of one manager.", 0, ""),
    ("Clerk", "", "An unpaid role.", -20, "pen_unpaid"),
    ("Clerk", "", "Contract-only.", -20, "pen_contract"),
    ("Clerk", "", "Contract only", -20, "pen_contract"),
    ("Clerk", "", "contract-to-hire", 0, ""),
    ("Clerk", "", "Unpaid, contract - ONLY, 5+ years", -60, "pen_contract,pen_unpaid,pen_years"),
    ("Clerk", "", "3-5 years", 0, ""),
    ("Clerk", "", "2+ years java, 5+ years overall", -20, "pen_years"),
    # Known false positive: the company's age counts as required years.
    ("Clerk", "", "a company of 20 years", -20, "pen_years"),
]

YEARS = {
    "5+ years": 5,
    "3-5 years": 3,
    "3 – 5 yrs.": 3,
    "3 to 5 years": 3,
    "10 or 12 years": 10,
    "2+ years java, 5+ years overall": 5,
    "5 + yrs": 5,
    "5 plus years": 5,
    "5-year minimum": 5,
    "3 - 5 + years": 3,
    "2+ to 4+ years": 2,
    "5 \n\u00a0 years": 5,
    "10years": 10,
    "version 1.2.3 years": 2,
    "1.5 years": 1,
    "a company of 20 years": 20,
    "since 2020 years passed": 2020,
    "99999999999999999999 years": 2**31 - 1,
    "000000000000005 years": 5,
    "65 years": 65,
    "70+ years of experience": 70,
    "five years": 5,
    "Five (5) years": 5,
    "5 or more years": 5,
    "minimum 5 full years": 5,
    "at least two to three years": 2,
    "twenty-five years": 25,
    "forty two yrs": 42,
    "ninety-nine years": 99,
    "often years": None,
    "someone years": None,
    "5 yearlings": None,
    "5 people": None,
    "0 years": 0,
    "": None,
    None: None,
}


@pytest.fixture(scope="module")
def cases(spark):
    data = [
        (i, f"https://x.example/{i}", title, location, description, SEEN)
        for i, (title, location, description, _, _) in enumerate(CASES)
    ]
    return spark.createDataFrame(data, POSTING)


def expected(column):
    return {i: case[column] for i, case in enumerate(CASES)}


@pytest.mark.parametrize("most_compiled", [match.MOST_COMPILED, 0])
def test_score(spark, cases, most_compiled):
    scored = match.score_postings(cases, default_rules(spark), most_compiled)
    got = {r.posting_id: (r.score, r.matched_rules) for r in scored.collect()}
    assert {i: s for i, (s, _) in got.items()} == expected(3)
    assert {i: m for i, (_, m) in got.items()} == expected(4)


@pytest.mark.parametrize("most_compiled", [match.MOST_COMPILED, 0])
def test_score_from_matches(spark, cases, most_compiled):
    matches = match.match_rules(cases, default_rules(spark), most_compiled)
    assert {r.posting_id: r.score for r in match.score(matches).collect()} == expected(3)
    reasons = match.explain_score(matches).collect()
    assert {r.posting_id: r.matched_rules for r in reasons} == expected(4)


def test_every_rule_hits_and_misses(spark, cases):
    matches = match.match_rules(cases, default_rules(spark))
    hits = {r.rule_id: r["count"] for r in matches.groupBy("rule_id").count().collect()}
    for rule in DEFAULT_RULES:
        assert 0 < hits[rule[0]] < len(CASES)


def test_forms_agree_on_awkward_rules(spark, cases):
    rules = spark.createDataFrame(
        [
            ("a", "role", "title", "Java -- Developer", 3),
            ("b", "role", "title", "engineer", -4),
            ("c", "location", "description", "years", 7),
            ("d", "penalty", "description", "you lead a staff of one manager", -1),
            ("e", "penalty", "title", "...", -9),
            ("f", "penalty", "years", "03", -2),
            ("g", "penalty", "location", "ROCHESTER minnesota", -8),
        ],
        RULE,
    )
    compiled = rows(match.match_rules(cases, rules))
    assert {r[2] for r in compiled} == {None, "a", "b", "c", "d", "f", "g"}
    assert rows(match.match_rules(cases, rules, 0)) == compiled
    score = rows(match.score_postings(cases, rules))
    assert rows(match.score_postings(cases, rules, 0)) == score
    # The same again without a broadcast.
    assert rows(match.match_rules(cases, rules, 0, 0)) == compiled


def test_no_rules(spark, cases):
    none = spark.createDataFrame([], RULE)
    assert {(r.score, r.matched_rules) for r in match.score_postings(cases, none).collect()} == {
        (0, "")
    }
    matches = match.match_rules(cases, none)
    assert matches.count() == len(CASES)
    assert matches.filter("rule_id IS NOT NULL").count() == 0


def test_unknown_rule_is_an_error(spark, cases):
    bad = spark.createDataFrame([("r", "bonus", "title", "x", 1)], RULE)
    with pytest.raises(Exception, match="cannot apply rule r"):
        match.match_rules(cases, bad)


def test_too_many_conditions_are_an_error(spark, cases):
    many = [(f"r{i}", "role", "title", "clerk", 1, "x", None) for i in range(101)]
    rules = spark.createDataFrame(many, CONDITIONAL_RULE)
    with pytest.raises(ValueError, match="conditions"):
        match.match_rules(cases, rules)


def test_texts_that_change_places_with_nulls(spark):
    """Copies of an id whose texts differ only in which of them is null."""
    text = "Remote, unpaid, 7 years"
    data = [(1, "a", "Clerk", text, None, SEEN), (1, "b", "Clerk", None, text, SEEN),
            (1, "c", None, text, None, SEEN), (1, "d", "Clerk", "", "", SEEN)]
    df = spark.createDataFrame(data, POSTING)
    for bounds in ({}, {"most_compiled": 0}, {"most_compiled": 0, "most_broadcast": 0}):
        got = {r.url: r.score for r in match.score_postings(df, default_rules(spark), **bounds).collect()}
        assert got == {"a": 5, "b": -40, "c": 5, "d": 0}


@pytest.mark.parametrize("most_compiled", [match.MOST_COMPILED, 0])
def test_unusable_rules_tables(spark, cases, most_compiled):
    twice = spark.createDataFrame(
        [("r", "role", "title", "a", 1), ("r", "role", "title", "b", 1)], RULE
    )
    with pytest.raises(ValueError, match="unique"):
        match.match_rules(cases, twice, most_compiled)
    for years in ("many", "-1"):
        bad = spark.createDataFrame([("r", "penalty", "years", years, -1)], RULE)
        with pytest.raises(Exception, match="cannot apply rule r"):
            match.match_rules(cases, bad, most_compiled)


def test_many_rules_against_brute_force(spark, cases):
    """More rules than are compiled: every pair of words of the cases."""
    words = sorted({w for c in CASES for w in re.findall(r"[a-z0-9]+", (c[0] or "").lower())})[:30]
    terms = [*words, *[f"{a} {b}" for a, b in itertools.product(words, words)]]
    assert len(terms) > match.MOST_COMPILED
    rules = spark.createDataFrame(
        [(t, "penalty", "title", t, -1) for t in terms], RULE
    )
    got = {
        (r.posting_id, r.rule_id)
        for r in match.match_rules(cases, rules).collect()
        if r.rule_id is not None
    }
    want = {
        (i, t)
        for i, case in enumerate(CASES)
        for t in terms
        if f" {t} " in " " + re.sub(r"[\W_]+", " ", case[0].lower()) + " "
    }
    assert got == want


def test_phrases_on_random_texts(spark):
    """The direct test, the normalised text and plain Python agree."""
    rng = random.Random(11)
    pieces = ["lead", "Lead", "java", "script", "née", "É", "5", "ß", " ", "  ", "-", "_", "\n", "…"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(3000)]
    phrases = ["lead", "java", "java script", "lead java lead", "5", "née", "lead 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = df.select(
        "t",
        *[holds(lowered(F.col("t")), p).alias(f"a{i}") for i, p in enumerate(phrases)],
        *[
            normalised(F.col("t")).contains(f" {p} ").alias(f"b{i}")
            for i, p in enumerate(phrases)
        ],
    )
    seen = set()
    for row in df.collect():
        words = " " + re.sub(r"[\W_]+", " ", row.t.lower()).strip() + " "
        for i, phrase in enumerate(phrases):
            want = f" {phrase} " in words
            assert row[f"a{i}"] == row[f"b{i}"] == want, (row.t, phrase)
            seen.add((phrase, want))
    assert len(seen) == 2 * len(phrases)


def test_years(spark):
    df = spark.createDataFrame(list(enumerate(YEARS)), "posting_id long, description string")
    got = {r.description: r for r in classify.years_required(df).collect()}
    assert {d: r.years_required for d, r in got.items()} == YEARS
    assert {d: r.many_years for d, r in got.items()} == {
        d: n is not None and n >= 5 for d, n in YEARS.items()
    }


def test_matching_is_linear_in_the_text(spark):
    """Long runs of one kind would take hours if a pattern retried them."""
    n = 50_000
    runs = ["5" + " " * n, "five " * n, "twenty-" * n, "5 (" * n, "5 or " * n, "rochester " * n, "1" * n, "3-" * n, "<" * n, "<script " * n,
            "<script></script " * n, "<title " * n, "<html " * n, "&" * n, "<!-" * n, "lead-" * n]
    df = spark.createDataFrame([(r + "x 7 years",) for r in runs], "description string")
    df = df.withColumns({"title": F.col("description"), "html": F.col("description")})
    df = classify.is_senior(classify.years_required(page_text(page_fields(
        df.withColumn("url", F.lit("https://x.example"))
    ))))
    start = time.monotonic()
    got = df.collect()
    assert time.monotonic() - start < 60
    assert [r.years_required for r in got] == [7] * len(runs)


def test_flags_and_filters(spark, cases):
    flags = classify.is_senior(classify.is_unpaid(classify.is_contract_only(cases)))
    got = {r.posting_id: r for r in classify.not_entry_level(flags).collect()}
    ids = expected(4)
    senior = {"pen_senior", "pen_staff", "pen_principal", "pen_lead", "pen_arch", "pen_mgr"}
    for i, matched in ids.items():
        hit = set(matched.split(","))
        assert got[i].is_senior == bool(hit & senior), CASES[i]
        assert got[i].is_unpaid == ("pen_unpaid" in hit), CASES[i]
        assert got[i].is_contract_only == ("pen_contract" in hit)
        assert got[i].not_entry_level == bool(hit & (senior | {"pen_years"}))
    kept = {r.posting_id for r in classify.junior_friendly(cases).collect()}
    assert kept == {i for i, r in got.items() if not r.not_entry_level}
    clean = {r.posting_id for r in classify.drop_disqualified(cases).collect()}
    assert clean == {i for i, matched in ids.items() if "pen_" not in matched}


def test_classes(spark, cases):
    df = classify.location_class(classify.role_class(cases))
    got = {(r.title, r.location): (r.role_class, r.location_class) for r in df.collect()}
    assert got["React / TypeScript Developer", ""] == ("react / typescript developer", "other")
    assert got["Junior Cloud Engineer", ""] == ("junior aws or cloud", "other")
    assert got["Full-Stack Developer", ""] == ("full-stack developer", "other")
    assert got["Entry-Level Software Developer", None] == (
        "entry-level software developer",
        "other",
    )
    assert got["Clerk", "Rochester, Minnesota"] == ("other", "minnesota")
    assert got["Clerk", "Hybrid - Twin Cities"] == ("other", "twin cities")
    assert got["Application  Developer", "hybrid"] == ("application developer", "hybrid")
    assert got["Junior Software Engineer", "Remote"] == ("junior software engineer", "remote")


def test_validate(spark):
    raw = spark.createDataFrame(
        [
            ("1", "https://a", "Clerk", "2024-05-01 12:00:00"),
            ("x", "https://b", "Clerk", "2024-05-01 12:00:00"),
            ("3", "", "Clerk", "2024-05-01 12:00:00"),
            ("4", "https://d", None, "2024-05-01 12:00:00"),
            ("5", "https://e", " \t", "soon"),
            ("6", None, "Clerk", None),
        ],
        "posting_id string, url string, title string, seen_at string",
    ).withColumn("source", F.lit("s"))
    valid, rejected = validate(raw)
    assert valid.schema.fieldNames() == [*POSTING.fieldNames(), "source"]
    row = valid.collect()
    assert [(r.posting_id, r.url, r.seen_at, r.description) for r in row] == [
        (1, "https://a", SEEN, None)
    ]
    assert rejected.schema.fieldNames() == [*raw.columns, "reject_reason"]
    assert {r.posting_id: r.reject_reason for r in rejected.collect()} == {
        "x": "bad_posting_id",
        "3": "no_url",
        "4": "no_title",
        "5": "bad_seen_at,no_title",
        "6": "bad_seen_at,no_url",
    }
    assert check_postings(raw).count() == raw.count()
