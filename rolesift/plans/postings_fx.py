"""Posting sightings derived from the ``orders`` test table, one per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
    ]
)

# Fixed values.
TITLES = [
    "Junior Software Engineer",
    "New Grad Software Engineer",
    "Entry-Level Software Developer",
    "Application Developer",
    "Frontend Developer",
    "Full-stack Developer",
    "Java Developer",
    "React / TypeScript Developer",
    "Junior AWS Engineer",
    "Senior Software Engineer",
    "Staff Engineer",
    "Engineering Manager",
]
LOCATIONS = [
    "Rochester, Minnesota",
    "Twin Cities",
    "Rochester",
    "Remote",
    "Hybrid - Twin Cities",
    "Austin",
    "Boston",
]


def _pick(values: list[str], number: Column) -> Column:
    at = (number % len(values) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def sightings(orders: DataFrame) -> DataFrame:
    """Works on a batch or a stream of orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    terms = (
        F.when(k % 7 == 0, "Contract-only")
        .when(k % 11 == 0, "Unpaid internship")
        .otherwise("Full-time")
    )
    return orders.select(
        k.alias("posting_id"),
        F.when(k % 89 == 0, "")
        .otherwise(F.concat(F.lit("https://jobs"), c % 5, F.lit(".example.com/p/"), c))
        .alias("url"),
        F.when(k % 97 != 0, _pick(TITLES, c)).alias("title"),
        _pick(LOCATIONS, c).alias("location"),
        F.concat(
            F.lit("Requires "), (k % 9).cast("string"), F.lit("+ years of experience. "),
            terms, F.lit("."),
        ).alias("description"),
        F.col("o_orderdate").alias("seen_at"),
    )


def postings_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet"))
