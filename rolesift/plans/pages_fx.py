"""Pages that say where a job is, from the ``pages`` test table, which does not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.sources.pages import scan_pages

# Fixed values.
PLACES = [
    "<p>Location: the engineering campus of our partner at the western riverside office park"
    " in Rochester, Minnesota. Join us.</p>",
    "<dl><dt>Location</dt><dd>St. Paul, Minnesota</dd></dl>",
    "<p><b>Work place</b>: Austin, Texas</p><p>We also hire remote.</p>",
    "<p>Based in - <i>Boston</i></p>",
    "<p>Our office is in the Twin Cities.</p>",
    "<p>An office by the sea.</p>",
    "<p>Location: R&eacute;mote village | <b>Remote</b> on some days</p>",
    "<h3>Location:</h3><ul><li>Hybrid - Minneapolis, MN</li></ul>",
]


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with one of the places after its heading."""
    place = F.element_at(
        F.array(*[F.lit(p) for p in PLACES]), (F.col("page_id") % len(PLACES) + 1).cast("int")
    )
    html = F.replace(F.col("html"), F.lit("</h1>"), F.concat(F.lit("</h1>"), place))
    return scan_pages(spark, f"{sf_dir}/pages.parquet").withColumn("html", html)
