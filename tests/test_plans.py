"""The physical plans that large data depends on, and hot keys."""

import re
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rolesift.functions.terms import default_rules
from rolesift.operators import match
from rolesift.operators.extract import page_fields, page_text, postings_from_pages
from rolesift.operators.latest import latest
from rolesift.operators.pending import new_postings, unreviewed
from rolesift.operators.review import review_list
from rolesift.operators.validate import validate
from rolesift.plans.flows import find_and_score
from rolesift.plans.postings_fx import postings_fx
from rolesift.schema import OUTBOX, POSTING, SCORED
from rolesift.session import scratch, shared_dir
from rolesift.sources.files import exists
from rolesift.sources.keyed import append_keyed, read_keyed, runs
from rolesift.sources.pages import scan_pages
from rolesift.sources.store import merge_newest
from rolesift.streaming.first_seen import first_seen
from rolesift.streaming.notify import already_sent

SF_DIR = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


def exchanges(text):
    return len(re.findall(r"\bExchange ", text))


@pytest.fixture(scope="module")
def valid(spark):
    return validate(postings_fx(spark, SF_DIR))[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Postings as files, one url holding a third of them."""
    path = f"{tmp_path_factory.mktemp('hot')}/postings"
    hot = F.when(F.col("posting_id") % 3 == 0, "https://hot.example").otherwise(F.col("url"))
    validate(postings_fx(spark, SF_DIR))[0].withColumn("url", hot).repartition(6).write.parquet(path)
    return spark.read.schema(POSTING).parquet(path)


@pytest.fixture
def settings(spark):
    changed = []

    def put(**values):
        for key, value in values.items():
            key = "spark.sql." + key.replace("__", ".")
            changed.append(key)
            spark.conf.set(key, value)

    yield put
    for key in changed:
        spark.conf.unset(key)


def test_page_scan_reads_only_what_is_used(spark):
    urls = scan_pages(spark, f"{SF_DIR}/pages.parquet").filter(F.col("url").startswith("https"))
    text = plan(urls.select("url"))
    assert "ReadSchema: struct<url:string>" in text
    assert "StringStartsWith(url,https)" in text
    host = page_fields(scan_pages(spark, f"{SF_DIR}/pages.parquet")).select("host")
    assert "html" not in plan(host)


def test_extraction_strips_each_page_once(spark):
    """One pass over each page, also where both its text and its fields are read."""
    pages = scan_pages(spark, f"{SF_DIR}/pages.parquet")
    postings = postings_from_pages(pages, F.current_timestamp())
    for df, passes in ((page_text(pages), 1), (page_fields(pages), 1), (postings, 1)):
        text = plan(df)
        assert len(re.findall(r"regexp_replace\(html#", text)) == passes
        assert exchanges(text) == 0


def test_valid_rows_are_filtered_in_the_scan(stored):
    text = plan(validate(stored)[0])
    for field in ("posting_id", "seen_at", "title", "url"):
        assert f"IsNotNull({field})" in text


def test_scoring_needs_no_shuffle_and_no_join(spark, valid):
    for df in (
        match.score_postings(valid, default_rules(spark)),
        match.match_rules(valid, default_rules(spark)),
    ):
        assert exchanges(plan(df)) == 0
        assert "Join" not in plan(df)
        assert "CartesianProduct" not in plan(df)


def test_flagship_shuffles_once(spark, stored):
    """One shuffle of a row per url and task; narrow if the description may go."""
    text = plan(find_and_score(stored, default_rules(spark)))
    assert exchanges(text) == 1
    above, below = text.split("Exchange hashpartitioning(url")
    assert "description" in above
    assert re.search(r"WindowGroupLimit .*Partial", below)
    text = plan(find_and_score(stored, default_rules(spark), description=False))
    assert exchanges(text) == 1
    assert "description" not in text.split("Exchange hashpartitioning(url")[0]


def test_score_from_matches_combines_before_its_shuffle(spark, valid):
    matches = match.match_rules(valid, default_rules(spark))
    for df in (match.score(matches), match.explain_score(matches)):
        assert exchanges(plan(df)) == 1
        assert "partial_" in plan(df).split("Exchange ")[1]


def test_many_rules_meet_by_equality(spark, valid, settings):
    text = plan(match.match_rules(valid, default_rules(spark), 0))
    assert "BroadcastHashJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text
    # Without a broadcast too, phrases are only built at a rule's first word.
    settings(autoBroadcastJoinThreshold="-1")
    text = plan(match.match_rules(valid, default_rules(spark), 0, 0))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Broadcast" not in text
    first, second = text.index("hashpartitioning(field"), text.rindex("hashpartitioning(field")
    assert first != second


def test_hot_word_is_split_without_a_broadcast(spark, stored, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="16KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__coalescePartitions__enabled="false",
    )
    hot = stored.withColumn("title", F.lit("Staff"))
    rules = default_rules(spark)
    split = match.match_rules(hot, rules, 0, 0)
    assert "skew=true" in final_plan(split)
    assert rows(split) == rows(match.match_rules(hot, rules))


def test_top_k_does_not_sort_everything(spark, valid):
    scored = match.score_postings(valid, default_rules(spark))
    assert "TakeOrderedAndProject" in plan(review_list(scored, 10))


def test_hot_url_is_reduced_before_the_shuffle(stored):
    df = latest(stored)
    text = final_plan(df)
    assert re.search(r"WindowGroupLimit .*Partial", text.split("Exchange ")[1])
    # Rows that crossed the shuffle: at most one per url and input partition.
    records = df._jdf.queryExecution().executedPlan()
    urls = stored.select("url").distinct().count()
    assert df.count() == urls
    per_task = (
        stored.withColumn("_task", F.spark_partition_id()).select("url", "_task").distinct().count()
    )
    assert shuffled_rows(records) == per_task < stored.count()


def shuffled_rows(node):
    """The largest count of records any shuffle of a finished plan wrote."""
    pending, most = [node], 0
    while pending:
        node = pending.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            pending.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            pending.append(node.plan())
        metric = node.metrics().get("shuffleRecordsWritten")
        if metric.isDefined():
            most = max(most, metric.get().value())
        children = node.children()
        pending += [children.apply(i) for i in range(children.size())]
    return most


def test_hot_url_of_a_scan_is_split(stored, settings):
    """All copies of an unsaved hot url stay, over several tasks."""
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="16KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__coalescePartitions__enabled="false",
    )
    store = stored.filter(F.col("url").endswith("4")).select("url")
    df = new_postings(stored, store)
    assert "skew=true" in final_plan(df)
    want = stored.filter(~F.col("url").endswith("4"))
    assert rows(df.select("posting_id", "url")) == rows(want.select("posting_id", "url"))


def test_hot_url_of_reviews_is_reduced_before_the_shuffle(stored, settings):
    settings(autoBroadcastJoinThreshold="-1")
    df = unreviewed(latest(stored), stored)
    final_plan(df)
    per_task = (
        stored.withColumn("_task", F.spark_partition_id()).select("url", "_task").distinct().count()
    )
    shuffled = shuffled_rows(df._jdf.queryExecution().executedPlan())
    assert 0 < shuffled <= per_task < stored.count()
    assert df.count() == 0


def test_small_save_leaves_the_store_in_place(spark, stored, tmp_path):
    """Neither the saved rows nor any wide column of them is shuffled."""
    scored = match.score_postings(latest(stored), default_rules(spark))
    scored.write.parquet(f"{tmp_path}/saved")
    scored.limit(20).write.parquet(f"{tmp_path}/fresh")
    saved, fresh = (
        spark.read.schema(SCORED).parquet(f"{tmp_path}/{n}") for n in ("saved", "fresh")
    )
    text = final_plan(merge_newest(saved, fresh))
    assert "SortMergeJoin" not in text.split("Initial Plan")[0]
    for shuffle in re.findall(r"Exchange hashpartitioning.*\n.*\n", text):
        assert "description" not in shuffle
    assert merge_newest(saved, fresh).count() == saved.count()


def test_growing_outbox_is_not_shuffled(spark, stored, tmp_path):
    outbox = stored.select("url", F.lit(15).cast("long").alias("score"), F.lit("").alias("matched_rules"))
    outbox.write.parquet(f"{tmp_path}/outbox")
    outbox.limit(20).write.parquet(f"{tmp_path}/strong")
    outbox, strong = (
        spark.read.schema(OUTBOX).parquet(f"{tmp_path}/{n}") for n in ("outbox", "strong")
    )
    text = final_plan(already_sent(outbox, strong)).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in text and exchanges(text) == 0


def test_first_seen_is_reduced_before_the_shuffle(stored):
    df = first_seen(stored)
    text = final_plan(df)
    assert "Python" not in text and "Arrow" not in text
    urls = stored.select("url").distinct()
    per_task = stored.withColumn("_task", F.spark_partition_id()).select("url", "_task").distinct()
    shuffled = shuffled_rows(df._jdf.queryExecution().executedPlan())
    assert shuffled <= per_task.count() < stored.count()
    assert rows(df.select("url")) == rows(urls)


def many_urls(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("https://jobs.example/"), F.sha2(F.col("id").cast("string"), 256)).alias("url"),
        F.lit(15).cast("long").alias("score"),
        F.lit("").alias("matched_rules"),
    )


def test_questions_to_a_large_folder_read_a_small_share(spark, tmp_path):
    """A thousand urls against a folder of some thousands of parts."""
    path, rows_ = f"{tmp_path}/outbox", many_urls(spark, 200_000)
    append_keyed(rows_, path, part_bytes=4 << 10)
    (run,) = runs(spark, path)
    assert run["parts"] >= 2048 and run["bytes"] < run["parts"] * (8 << 10)
    few = rows_.limit(1000)
    whole, asked = read_keyed(spark, path, OUTBOX), read_keyed(spark, path, OUTBOX, few)
    assert len(whole.inputFiles()) > 2000
    assert len(asked.inputFiles()) <= 1000
    assert asked.join(few, "url", "left_semi").count() == 1000
    one = read_keyed(spark, path, OUTBOX, rows_.limit(1))
    assert len(one.inputFiles()) == 1 and one.count() < 1000


def test_urls_of_a_store_are_shuffled_once(stored, settings):
    settings(autoBroadcastJoinThreshold="-1")
    assert exchanges(plan(new_postings(stored, stored))) == 2


def test_copies_of_a_posting_score_alike_in_both_forms(spark, stored, settings):
    """A third of the rows are sightings of one posting, with two texts."""
    rules = default_rules(spark)
    hot = stored.withColumn("copy", F.col("url") == "https://hot.example").select(
        F.when(F.col("copy"), F.lit(None)).otherwise(F.col("posting_id")).alias("posting_id"),
        "url",
        *[
            F.when(F.col("copy") & (F.col("posting_id") % 2 == 0), F.lit("Senior, unpaid"))
            .when(F.col("copy"), F.lit("Junior AWS, remote"))
            .otherwise(F.col(name))
            .alias(name)
            for name in match.TEXT_FIELDS
        ],
        "seen_at",
    )
    want = rows(match.score_postings(hot, rules))
    assert len({r[2] for r in want if r[-1] == "https://hot.example"}) == 2
    assert rows(match.score_postings(hot, rules, 0)) == want
    matches = rows(match.match_rules(hot, rules))
    assert rows(match.match_rules(hot, rules, 0)) == matches


def test_hot_copies_are_split_in_the_many_rules_form(spark, stored, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="16KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__coalescePartitions__enabled="false",
    )
    copy = F.col("url") == "https://hot.example"
    hot = stored.withColumns(
        {
            name: F.when(copy, F.lit(value)).otherwise(F.col(name))
            for name, value in (
                ("posting_id", 1), ("title", "Staff"), ("location", ""), ("description", "Unpaid"),
            )
        }
    )
    rules = default_rules(spark)
    split = match.score_postings(hot, rules, 0)
    assert "skew=true" in final_plan(split)
    assert rows(split) == rows(match.score_postings(hot, rules))


def test_shared_dir():
    def session(conf, master, made=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: made)
        conf = SimpleNamespace(get=lambda key, default: conf_value)
        return SimpleNamespace(conf=conf, sparkContext=context)

    conf_value = "hdfs://shared/work/"
    assert shared_dir(session(None, "yarn"), "x").startswith("hdfs://shared/work/rolesift/x-")
    conf_value = None
    assert shared_dir(session(None, "yarn", "s3a://b/c"), "x").startswith("s3a://b/c/rolesift/x-")
    with pytest.raises(ValueError):
        shared_dir(session(None, "yarn"), "x")


def test_scratch(spark):
    """Only what was given out inside is removed, also after an error."""
    outer = shared_dir(spark, "outer")
    spark.range(3).write.parquet(outer)
    made = []
    with pytest.raises(RuntimeError), scratch(spark):
        made.append(shared_dir(spark, "first"))
        spark.range(3).write.parquet(made[0])
        with scratch(spark):
            made.append(shared_dir(spark, "second"))
            spark.range(3).write.parquet(made[1])
        assert [exists(spark, x) for x in made] == [True, False]
        raise RuntimeError
    assert [exists(spark, x) for x in made] == [False, False]
    assert spark.read.parquet(outer).count() == 3
    with scratch(spark):
        shared_dir(spark, "never written")
