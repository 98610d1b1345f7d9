"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. As many whole epochs of it as fit are taken
first; the rest of the budget is filled by a weighted sample without
replacement. Each document draws an exponential key, ``-ln(u) / quality``, from
a hash of its id and the seed; documents are taken in order of their keys while
the budget lasts, and the document at the border is taken in part.

Budgets are found from sums over sources and bins; they are broadcast to the rows
while the sources are few enough, which is checked. Only a narrow table (row,
source, size, key) is sorted, and never a whole source
in one task: keys are put into ``BINS`` ordered bins, the bins' sums are summed
up along each source, and only the one bin that holds the border is put in order
by key. So a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
MOST_BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A document's quality weight, 0.05 to 1.05: the share of its characters
    that are neither digits nor markup signs."""
    junk = F.regexp_count(text, F.lit(r"[0-9#*$%&|<>]")).cast("double")
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.lit(0.05) + F.lit(1.0) - F.coalesce(junk / length, F.lit(0.0))


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and up to 1 from a hash of the key as text."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1.0) / float(16**13)


def targets(
    totals: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one for each source.

    Sources in order of their names, null last, get the weights in turn and
    share ``share`` times all words by weight. A target stops at
    ``most_epochs`` times the source's size; what is over goes to the others by
    weight, until none is above. Ordered by the level at which a source is
    full, those below a common level are full and the others share what is
    left: one sort of the sources finds that level. The sources meet in one
    task here, one row each."""
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    weighed = totals.withColumn("_weight", weight).withColumn(
        "_cap", F.lit(most_epochs) * F.col("source_size")
    )
    by_level = everything.orderBy(
        F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    to_share = F.lit(share) * F.sum("source_size").over(everything)
    left = to_share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.coalesce(
        F.sum("_weight").over(before), F.lit(0.0)
    )
    levels = (
        weighed.withColumn("_level", left / open_weight)
        .withColumn("_full", F.col("_cap") / F.col("_weight") <= F.col("_level"))
        .withColumn("_rank", F.row_number().over(by_level))
    )
    # The level of the first source that is not full holds for all after it.
    first_open = F.min(F.when(~F.col("_full"), F.struct("_rank", "_level"))).over(everything)
    level = first_open.getField("_level")
    return levels.withColumn(
        "target",
        F.when(level.isNull(), F.col("_cap")).otherwise(
            F.least(F.col("_cap"), F.col("_weight") * level)
        ),
    ).select("source", F.col("source_size"), "target")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(
    docs: DataFrame,
    seed: int = 0,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
    bins: int = BINS,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Rows (``keep`` columns, source, size, source_size, target, epochs, part,
    taken): a document is taken ``epochs`` times in full and then ``part`` words
    of it once more; ``taken`` is the sum in words. ``docs`` has doc_id, text and
    source.

    A null text has no words; a null source is a source of its own; ids may be
    null or repeated: rows that draw the same key are ordered by id, size and a
    hash of the text. Words taken from a source are its target, cut to a whole
    number. A source without words has target 0. An empty table gives an empty
    result. Columns beyond ``keep`` are not read."""
    spark = docs.sparkSession
    text = F.col("text")
    drawn = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        *([] if "doc_id" in keep else [F.col("doc_id")]),
        *([] if "source" in keep else [F.col("source")]),
        n_words(text).alias("size"),
        (-F.log(uniform(F.col("doc_id"), seed)) / quality(F.coalesce(text, F.lit("")))).alias("_key"),
        F.xxhash64("text").alias("_tie"),
    ).withColumn("_bin", F.floor((1.0 - F.exp(-F.col("_key"))) * bins).cast("int"))
    # Used three times below: written out, texts are read once, and every reader
    # sees the same rows.
    path = shared_dir(spark, "mixing")
    drawn.write.parquet(path)
    drawn = spark.read.parquet(path)
    per_bin = drawn.groupBy("source", "_bin").agg(F.sum("size").alias("_bin_size"))
    sources = targets(
        per_bin.groupBy("source").agg(F.sum("_bin_size").alias("source_size")),
        weights,
        share,
        most_epochs,
    )
    size = F.col("source_size")
    sources = sources.withColumn(
        "epochs",
        F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"),
    ).withColumn("_budget", F.floor(F.col("target")).cast("long") - F.col("epochs") * size)
    along = Window.partitionBy("source").orderBy("_bin")
    bin_before = F.sum("_bin_size").over(along) - F.col("_bin_size")
    borders = (
        per_bin.withColumn("_before", bin_before)
        .join(sources.withColumnRenamed("source", "_source"), _same(F.col("source"), F.col("_source")))
        # One bin for each source: the first whose end reaches the budget.
        .filter(
            (F.col("_before") <= F.col("_budget"))
            & (F.col("_before") + F.col("_bin_size") > F.col("_budget"))
        )
        .select("source", F.col("_bin").alias("_border"), "_before")
    )
    sources = sources.join(
        borders.withColumnRenamed("source", "_source"),
        _same(F.col("source"), F.col("_source")),
        "left",
    ).drop("_source")
    sources.withColumnRenamed("source", "_source").write.parquet(f"{path}-sources")
    sources = spark.read.parquet(f"{path}-sources")
    if sources.count() <= MOST_BROADCAST_ROWS:
        sources = F.broadcast(sources)
    rows = drawn.join(sources, _same(F.col("source"), F.col("_source"))).drop("_source")
    in_border = _same(F.col("_bin"), F.col("_border"))
    whole = rows.filter(~in_border).withColumn(
        "part", F.when(F.col("_bin") < F.col("_border"), F.col("size")).otherwise(0).cast("long")
    )
    by_key = Window.partitionBy("source").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    left = F.col("_budget") - F.col("_before") - (F.sum("size").over(by_key) - F.col("size"))
    border = rows.filter(in_border).withColumn(
        "part", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long")
    )
    names = [*keep, *([] if "source" in keep else ["source"])]
    return whole.unionByName(border).select(
        *[F.col(f"`{c}`") for c in names],
        "size",
        "source_size",
        "target",
        "epochs",
        "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixture itself: ``docs``' columns, a row for each time a document is
    taken. The document at a source's border is taken once more if at least half
    of it is in the budget. Documents without words stay, once. Repeated rows are
    taken equally often, rounded up. The texts are not shuffled while the
    decisions are few enough for Spark to broadcast."""
    tie = F.xxhash64("text", "source").alias("__tie")
    picks = mix(
        docs.select("doc_id", "text", "source", tie), seed, keep=("doc_id", "__tie")
    ).select(
        F.col("doc_id").alias("__pick_id"),
        F.col("__tie").alias("__pick_tie"),
        F.when(F.col("size") == 0, F.lit(1))
        .otherwise(F.col("epochs") + F.when(F.col("part") * 2 >= F.col("size"), 1).otherwise(0))
        .cast("int")
        .alias("__times"),
    )
    # Equal rows share one pick: they draw the same key, and the border may lie
    # between them.
    picks = picks.groupBy("__pick_id", "__pick_tie").agg(
        F.ceil(F.sum("__times") / F.count("*")).cast("int").alias("__times")
    )
    # The rows travel as structs, so that none of their names is in the way.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("__id"),
        tie,
    )
    return (
        rows.join(
            picks.filter(F.col("__times") > 0),
            _same(F.col("__id"), F.col("__pick_id")) & (F.col("__tie") == F.col("__pick_tie")),
        )
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select("row.*")
    )
