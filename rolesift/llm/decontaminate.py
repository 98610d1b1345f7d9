"""Finding and removing benchmark passages in training documents.

Benchmark texts are cut into windows of ten words; a shorter item is one window.
The distinct windows, with their hashes, are broadcast once their number and
bytes have been checked, and every window of every document is looked up by hash
and verified on its words. What is left are the hits, few against the input; they
are gathered for each text. Only hits and narrow rows are shuffled.

A window can only occur where the words of benchmark texts do. Where those words
are few enough to write into the plan, a window is only built if its first,
middle and last word are among them.

Texts are cut into words once, in blocks of ``BLOCK`` words that overlap by one
window, so that a very long text never stands in memory as all of its windows.
Copies of a text share their hits: a hit is keyed by 128 bits of hash of its
text, and repeats are dropped before they are shuffled.
"""

from __future__ import annotations

import string
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK = 2048
MOST_BROADCAST_BYTES = 64 << 20
MOST_KNOWN = 20_000  # words written into the plan
#: Everything that stands between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    lowered = F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )
    return F.array_remove(F.split(lowered, BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct rows (_hash, _window, _length, _items): each window, its number
    of words, and the items that hold it. ``benchmark`` has item_id and text; a
    null id is the item ``null``."""
    w = F.col("_words")
    count = F.size(w)
    length = F.least(count, F.lit(window))
    starts = F.sequence(F.lit(1), count - length + 1)
    return (
        benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("_item"),
            words(F.col("text")).alias("_words"),
        )
        .filter(count > 0)
        .select(
            "_item",
            length.alias("_length"),
            F.explode(
                F.transform(starts, lambda i: F.array_join(F.slice(w, i, length), " "))
            ).alias("_window"),
        )
        .groupBy("_window", "_length")
        .agg(F.collect_set("_item").alias("_items"))
        .withColumn("_hash", F.xxhash64("_window"))
    )


def _text_key() -> list[Column]:
    """128 bits that stand for a text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("__text_a"), F.xxhash64(F.lit(7), text).alias("__text_b")]


KEY = ["__text_a", "__text_b"]


def text_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    most_broadcast_bytes: int = MOST_BROADCAST_BYTES,
) -> DataFrame:
    """One row for each distinct text with a hit: (__text_a, __text_b, items,
    n_hit), where items are sorted ids and n_hit counts its words inside any
    occurrence of a window."""
    tests = benchmark_windows(benchmark, window)
    sizes = tests.agg(
        F.coalesce(F.sum(F.length("_window") + 64), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set("_length")).alias("lengths"),  # at most ``window`` numbers
    ).first()
    lengths = [int(n) for n in sizes["lengths"]] or [window]
    known = tests.select(F.explode(F.split("_window", " ")).alias("word")).distinct()
    known = [r["word"] for r in known.limit(MOST_KNOWN + 1).collect()]
    if sizes["bytes"] <= most_broadcast_bytes:
        tests = F.broadcast(tests)
    longest = max(lengths)
    w = F.col("_words")
    blocks = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int"))
    block = F.col("_block")

    def windows_of(n: int) -> Column:
        # Windows that start in this block's first BLOCK words.
        last = F.least(F.size(block) - n, F.lit(BLOCK - 1))
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(
            F.array().cast("array<int>")
        )
        if len(known) <= MOST_KNOWN:
            places = sorted({0, n // 2, n - 1})
            starts = F.filter(
                starts,
                lambda i: reduce(and_, [F.get(block, i + k).isin(known) for k in places]),
            )
        return F.transform(
            starts,
            lambda i: F.struct(
                (F.col("_at") + i).alias("at"),
                F.lit(n).alias("length"),
                F.array_join(F.slice(block, i + 1, n), " ").alias("window"),
            ),
        )

    scanned = (
        docs.select(*_text_key(), words(F.col("text")).alias("_words"))
        .filter(F.size(w) > 0)
        .select(
            *KEY,
            F.explode(
                F.transform(
                    blocks,
                    lambda b: F.struct(
                        (b * BLOCK).alias("at"),
                        F.slice(w, b * BLOCK + 1, BLOCK + longest - 1).alias("words"),
                    ),
                )
            ).alias("_b"),
        )
        .select(*KEY, F.col("_b.at").alias("_at"), F.col("_b.words").alias("_block"))
        .select(*KEY, F.explode(F.concat(*map(windows_of, lengths))).alias("_w"))
        .select(
            *KEY,
            F.col("_w.at").alias("_at"),
            F.col("_w.length").alias("_n"),
            F.col("_w.window").alias("_text"),
            F.xxhash64("_w.window").alias("_key"),
        )
    )
    hits = scanned.join(
        tests,
        (F.col("_key") == F.col("_hash"))
        & (F.col("_n") == F.col("_length"))
        & (F.col("_text") == F.col("_window")),
    )
    covered = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["n"]).alias("end"),
            (
                acc["n"]
                + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(acc["end"], s["at"]))
            ).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return (
        hits.groupBy(*KEY)
        .agg(
            F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_n").alias("n"))).alias(
                "_spans"
            ),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
        )
        .select(*KEY, "items", covered.alias("n_hit"))
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_words, n_hit, n_items,
    items, contaminated). A null or empty text has no words; without benchmark
    items nothing is hit; ids may be null or repeated."""
    narrow = docs.select(
        "doc_id", *_text_key(), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    hits = text_hits(docs, benchmark, window)
    none = F.array().cast("array<string>")
    return narrow.join(hits, KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark window."""
    # The rows travel as structs, so that none of their names is in the way.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_text_key()
    )
    hits = text_hits(docs, benchmark, window).select(*KEY)
    return rows.join(hits, KEY, "left_anti").select("row.*")
