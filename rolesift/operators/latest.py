"""The newest version of each posting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(postings: DataFrame) -> DataFrame:
    """One row per url: the one seen last, the larger posting id on a tie.

    Spark keeps only the first row per url of every input partition before the
    shuffle, so a url that holds most of the rows sends one row per task. Drop
    columns that are not needed before calling: the survivors are shuffled.
    """
    newest = Window.partitionBy("url").orderBy(F.desc("seen_at"), F.desc("posting_id"))
    return (
        postings.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
