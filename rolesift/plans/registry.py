"""The registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.terms import default_rules, rules_table
from rolesift.operators import classify, extract, match, pending, review
from rolesift.operators.latest import latest as newest
from rolesift.operators.validate import validate
from rolesift.plans import flows
from rolesift.plans.pages_fx import located
from rolesift.plans.postings_fx import ORDERS, postings_fx, sightings
from rolesift.plans.wordings_fx import swapped, worded
from rolesift.schema import PAGE, POSTING
from rolesift.session import shared_dir
from rolesift.sources.jsonl import read_json, write_json
from rolesift.sources.outbox import read_outbox, write_outbox
from rolesift.sources.pages import scan_pages as read_pages
from rolesift.sources.store import compact, retain
from rolesift.sources.store import list_postings as saved_postings
from rolesift.sources.store import save_postings as save
from rolesift.streaming.by_state import put_aside_late, read_late, run_first_seen_by_state
from rolesift.streaming.first_seen import PERIOD, read_first_seen, run_first_seen
from rolesift.streaming.notify import notify_stream as start_notifying
from rolesift.streaming.scan import run_scan
from rolesift.streaming.scan import scan_stream as landed
from rolesift.streaming.watch import watch_pages as start_watching

#: Rows of a landed file at most: a file of one row group is one task's work.
SCAN_ROWS = 250_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Rules whose words occur in the test pages, which hold no job
# vocabulary.
PAGE_RULES = [
    ("page_the", "role", "title", "the", 10),
    ("page_and", "role", "title", "and", 8),
    ("page_of", "location", "location", "of", 5),
    ("page_de", "location", "location", "de", 3),
    ("page_la", "penalty", "title", "la", -20),
    ("page_in_the", "penalty", "description", "in the", -7),
    ("page_que_de", "penalty", "description", "que de", -3),
]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(postings_fx(spark, sf_dir))[0]


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(_valid(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.find_and_score(postings_fx(spark, sf_dir), default_rules(spark))


def _customer() -> Column:
    """The number at the end of a derived url."""
    return F.regexp_extract("url", "([0-9]+)$", 1).cast("long")


def _shown(df: DataFrame) -> DataFrame:
    """Times as text, which every engine prints alike."""
    return df.withColumn("seen_at", F.col("seen_at").cast("string"))


def _scans(df: DataFrame, folder: str, *parts: Column) -> Iterator[str]:
    """Lands the rows of one part after another, in files of ``SCAN_ROWS`` however
    the table is laid out, and gives the folder after each: a run of a stream then
    takes what has landed since the run before as one batch, over many tasks."""
    for part in parts:
        landing = df.filter(part).write.option("maxRecordsPerFile", SCAN_ROWS)
        landing.mode("append").parquet(folder)
        yield folder


def _landing(sf_dir: str, table: str) -> str:
    """A glob, so that a table may be one file or a folder of files."""
    return f"{sf_dir}/{table}*.parquet"


# Sources and sinks


@query
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


@query
def pages_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "pages-json")
    write_json(read_pages(spark, f"{sf_dir}/pages.parquet"), path)
    return read_json(spark, path, PAGE, raw_line=None)


@query
def postings_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "postings-json")
    micros = F.unix_micros("seen_at") + F.col("posting_id") * 7919 % 1_000_000
    write_json(_valid(spark, sf_dir).withColumn("seen_at", F.timestamp_micros(micros)), path)
    return _shown(read_json(spark, path, raw_line=None))


@query
def save_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saves with shared urls: the second updates, adds and is outdated."""
    store = shared_dir(spark, "store")
    scored = match.score_postings(_valid(spark, sf_dir), default_rules(spark))
    save(scored.filter(F.col("posting_id") % 2 == 0), store)
    save(scored.filter(F.col("posting_id") % 2 == 1), store)
    return _shown(saved_postings(spark, store))


@query
def compacted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three saves, a compaction, one more save, and nothing old retained."""
    store = shared_dir(spark, "store")
    scored = match.score_postings(_valid(spark, sf_dir), default_rules(spark))
    for part in range(4):
        if part == 3:
            compact(spark, store)
        save(scored.filter(F.col("posting_id") % 4 == part), store)
    retain(spark, store)
    return _shown(saved_postings(spark, store))


@query
def list_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared_dir(spark, "store")
    save(_scored(spark, sf_dir), store)
    saved = saved_postings(spark, store, F.col("score") > 0)
    return _shown(saved.drop("matched_rules"))


@query
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "outbox")
    strong = review.strong_fits(_scored(spark, sf_dir))
    write_outbox(strong.filter(_customer() % 4 == 0), path)
    write_outbox(pending.unnotified(strong, read_outbox(spark, path)), path)
    return read_outbox(spark, path)


# Extraction


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    return extract.page_text(pages).select("page_id", "text")


@query
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    return extract.page_fields(pages).drop("html")


@query
def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to valid postings, scored with rules that suit the test pages."""
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    seen_at = F.timestamp_seconds(F.col("page_id"))
    raw = extract.postings_from_pages(pages, seen_at).withColumn("location", F.col("title"))
    rules = rules_table(spark, PAGE_RULES)
    return flows.find_and_score(raw, rules).select("url", "title", "score", "matched_rules")


@query
def page_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to postings whose places the pages themselves name, scored."""
    raw = extract.postings_from_pages(located(spark, sf_dir), F.timestamp_seconds(F.col("page_id")))
    df = match.score_postings(raw, default_rules(spark))
    return df.select("posting_id", "location", "score", "matched_rules")


# Validation, classes, flags and filters


@query
def valid_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_valid(spark, sf_dir))


@query
def rejected_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(validate(postings_fx(spark, sf_dir))[1])


@query
def role_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.role_class(_valid(spark, sf_dir))
    return df.select("posting_id", "title", "role_class")


@query
def location_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.location_class(_valid(spark, sf_dir))
    return df.select("posting_id", "location", "location_class")


@query
def is_senior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.is_senior(_valid(spark, sf_dir)).select("posting_id", "is_senior")


@query
def years_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.years_required(_valid(spark, sf_dir))
    return df.select("posting_id", "years_required", "many_years")


@query
def is_unpaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.is_unpaid(_valid(spark, sf_dir)).select("posting_id", "is_unpaid")


@query
def is_contract_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.is_contract_only(_valid(spark, sf_dir))
    return df.select("posting_id", "is_contract_only")


@query
def not_entry_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.not_entry_level(_valid(spark, sf_dir))
    return df.select("posting_id", "not_entry_level")


@query
def junior_friendly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.junior_friendly(_valid(spark, sf_dir))
    return df.select("posting_id", "title", "description")


@query
def drop_disqualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.drop_disqualified(_valid(spark, sf_dir))
    return df.select("posting_id", "title", "description")


@query
def worded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and flags of common wordings."""
    df = classify.role_class(classify.location_class(worded(spark, sf_dir)))
    df = classify.is_senior(classify.is_unpaid(classify.is_contract_only(df)))
    df = classify.years_required(classify.not_entry_level(df))
    return df.drop("url", "title", "location", "description", "seen_at")


@query
def worded_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.drop_disqualified(worded(spark, sf_dir)).select("posting_id")


# Matching and scoring


@query
def worded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match.score_postings(worded(spark, sf_dir), default_rules(spark))
    return df.select("posting_id", "score", "matched_rules")


@query
def worded_scores_by_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match.score_postings(worded(spark, sf_dir), default_rules(spark), most_compiled=0)
    return df.select("posting_id", "score", "matched_rules")


def _swapped(spark: SparkSession, sf_dir: str, **bounds: int) -> DataFrame:
    df = match.score_postings(swapped(spark, sf_dir), default_rules(spark), **bounds)
    return df.select("posting_id", "url", "score", "matched_rules")


@query
def swapped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids, and texts that change places with nulls."""
    return _swapped(spark, sf_dir)


@query
def swapped_scores_by_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swapped(spark, sf_dir, most_compiled=0)


@query
def swapped_scores_unbroadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for rules that are too many to broadcast."""
    return _swapped(spark, sf_dir, most_compiled=0, most_broadcast=0)


@query
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_rules(_valid(spark, sf_dir), default_rules(spark))


@query
def match_rules_by_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for large rules tables, chosen here by a bound of no rules."""
    return match.match_rules(_valid(spark, sf_dir), default_rules(spark), most_compiled=0)


@query
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.score(match_rules(spark, sf_dir))


@query
def explain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.explain_score(match_rules(spark, sf_dir))


@query
def score_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match.score_postings(_valid(spark, sf_dir), default_rules(spark))
    return df.select("posting_id", "score", "matched_rules")


@query
def find_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scored(spark, sf_dir))


# Newest versions, pending work, review


@query
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_newest(spark, sf_dir))


@query
def new_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _newest(spark, sf_dir)
    store = scan.filter(_customer() % 2 == 0)
    return pending.new_postings(scan, store).select("posting_id", "url", "title")


@query
def unnotified(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = review.strong_fits(_scored(spark, sf_dir))
    sent = strong.filter(_customer() % 4 == 0)
    return pending.unnotified(strong, sent).select("posting_id", "url", "score")


@query
def unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews are taken from all sightings, so a url has several."""
    reviews = _valid(spark, sf_dir).filter(_customer() % 3 == 0)
    return pending.unreviewed(_scored(spark, sf_dir), reviews).select("posting_id", "url", "score")


@query
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select("posting_id", "url", "title", "score", "matched_rules")
    return review.review_list(scored)


@query
def review_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select("posting_id", "url", "title", "score", "matched_rules")
    return review.review_list(scored, 100)


@query
def strong_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = review.strong_fits(_scored(spark, sf_dir))
    return strong.select("posting_id", "url", "score", "matched_rules")


@query
def save_and_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan into a store that holds half of the urls already."""
    store = shared_dir(spark, "store")
    scored = _scored(spark, sf_dir)
    save(scored.filter(_customer() % 2 == 0), store)
    reviews = _valid(spark, sf_dir).filter(_customer() % 3 == 0)
    return _shown(flows.save_and_review(scored, store, reviews, update=False))


# Streaming


@query
def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same landing folder: the second finds nothing new."""
    work = shared_dir(spark, "scan")
    for _ in range(2):
        run_scan(landed(spark, _landing(sf_dir, "pages")), f"{work}/pages", f"{work}/checkpoint")
    return spark.read.schema(PAGE).parquet(f"{work}/pages")


def _overlapping(spark: SparkSession, sf_dir: str, work: str) -> Iterator[DataFrame]:
    """A stream of sightings after each of four overlapping scans, a batch each."""
    k = F.col("o_orderkey")
    orders = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    parts = (k % 3 == 0, k % 3 <= 1, k % 2 == 0, k % 2 == 1)
    for folder in _scans(orders, f"{work}/landing", *parts):
        yield validate(sightings(landed(spark, folder, ORDERS)))[0]


@query
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_dir(spark, "first-seen")
    for stream in _overlapping(spark, sf_dir, work):
        run_first_seen(stream, f"{work}/urls", f"{work}/checkpoint")
    return read_first_seen(spark, f"{work}/urls", POSTING).select("url")


@query
def first_seen_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls are new again in every period of 200 days; files are not in order of
    time, so most sightings come late."""
    work = shared_dir(spark, "first-seen-within")
    for stream in _overlapping(spark, sf_dir, work):
        run_first_seen(stream, f"{work}/urls", f"{work}/checkpoint", days=200)
    seen = read_first_seen(spark, f"{work}/urls", POSTING)
    period = F.floor(F.unix_timestamp("seen_at") / (200 * 86_400)).cast("long")
    return seen.select("url", period.alias(PERIOD))


@query
def first_seen_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_dir(spark, "first-seen-by-state")
    for stream in _overlapping(spark, sf_dir, work):
        run_first_seen_by_state(stream, f"{work}/urls", f"{work}/checkpoint")
    return spark.read.schema(POSTING).parquet(f"{work}/urls").select("url")


@query
def late_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings a year or more behind what had landed before."""
    work = shared_dir(spark, "late")
    for stream in _overlapping(spark, sf_dir, work):
        put_aside_late(
            stream, f"{work}/routed", f"{work}/checkpoint", "365 days"
        ).awaitTermination()
    late = read_late(spark, f"{work}/routed", POSTING)
    return late.groupBy("posting_id", "url").agg(F.count("*").alias("times"))


@query
def notify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches in order of time, and a fourth of sightings that come late:
    none of them is newer than what was processed."""
    work = shared_dir(spark, "notify")
    orders = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    date, k = F.col("o_orderdate"), F.col("o_orderkey")
    late = (k % 5 == 0) & (date < "1997-01-01")
    early = ~late & (date < "1994-01-01")
    middle = ~late & date.between("1994-01-01", "1996-12-31 23:59:59")
    parts = (early, middle, ~late & (date >= "1997-01-01"), late)
    for folder in _scans(orders, f"{work}/landing", *parts):
        start_notifying(
            sightings(landed(spark, folder, ORDERS)),
            default_rules(spark),
            f"{work}/outbox",
            f"{work}/checkpoint",
        ).awaitTermination()
    return read_outbox(spark, f"{work}/outbox")


@query
def watch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in two overlapping scans, to the outbox, with rules that suit them."""
    work = shared_dir(spark, "watch")
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    page = F.col("page_id")
    parts = (page % 3 <= 1, page % 3 >= 1)
    for folder in _scans(pages, f"{work}/landing", *parts):
        start_watching(
            spark,
            folder,
            rules_table(spark, PAGE_RULES),
            f"{work}/seen",
            f"{work}/outbox",
            f"{work}/checkpoint",
            threshold=8,
            seen_at=F.timestamp_seconds(page),
            location=F.col("title"),
        ).awaitTermination()
    return read_outbox(spark, f"{work}/outbox")
