"""Postings in real wordings, one per row of the ``orders`` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.plans.postings_fx import ORDERS

# Fixed values.
TITLES = [
    "Front-End Developer",
    "Fullstack Developer",
    "Sr. Java Developer",
    "Unpaid Frontend Developer",
    "Java Developer (Contract Only)",
    "JavaScript Developer",
    "Jr. Software Engineer",
    "Leadership Trainer",
    "New Graduate Software Engineer",
    "Manager, React",
]
LOCATIONS = [
    "Hybrid - London",
    "Hybrid - Minneapolis, MN",
    "Rochester, New York",
    "Rochester, MN",
    "Hybrid",
    "Hybrid (Rochester, NY)",
    "St. Paul",
    "Remote or hybrid",
    "Twin Cities",
    None,
]
DESCRIPTIONS = [
    "five (5) years of experience",
    "5 or more years",
    "at least four years",
    "minimum 5 full years",
    "65 years",
    "twenty-five years in business, two years of Java",
    "Unpaid parental leave is offered.",
    "An unpaid trial week, then unpaid leave.",
    "contract-only",
    "contract-to-hire, 3 to 5 yrs",
    None,
]


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title meets every location and every description."""
    orders = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")

    def pick(values: list[str | None], number):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))

    return orders.select(
        k.alias("posting_id"),
        F.concat(F.lit("https://jobs.example.com/"), k).alias("url"),
        pick(TITLES, k).alias("title"),
        pick(LOCATIONS, F.floor(k / 10)).alias("location"),
        pick(DESCRIPTIONS, F.floor(k / 100)).alias("description"),
        F.col("o_orderdate").cast("timestamp").alias("seen_at"),
    )


def swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings whose ids repeat and whose texts stand now in the location, now
    in the description, the other being null."""
    df = worded(spark, sf_dir)
    turn = F.col("posting_id") % 3
    text = F.when(F.col("posting_id") % 2 == 0, "Remote, unpaid, contract only, 6 years")
    return df.select(
        (F.col("posting_id") % 50).alias("posting_id"),
        "url",
        F.when(turn != 2, F.col("title")).alias("title"),
        F.when(turn == 0, text).alias("location"),
        F.when(turn == 1, text).alias("description"),
        "seen_at",
    )
