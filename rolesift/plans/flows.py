"""The flows: find and score, then save and list for review."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rolesift.operators.latest import latest
from rolesift.operators.match import score_postings
from rolesift.operators.pending import new_postings, unreviewed
from rolesift.operators.review import review_list
from rolesift.operators.validate import validate
from rolesift.sources.store import list_postings, save_postings


def find_and_score(raw: DataFrame, rules: DataFrame, description: bool = True) -> DataFrame:
    """Newest valid version of each posting with its score and reasons.

    Scores before the shuffle by url, where the description is read, and shuffles
    one row per url and task. Without ``description`` that column, by far the
    widest, is dropped there: for what is notified, not for what is saved.
    """
    valid, _ = validate(raw)
    scored = score_postings(valid, rules)
    return latest(scored if description else scored.drop("description"))


def save_and_review(
    scan: DataFrame,
    store: str,
    reviews: DataFrame,
    k: int | None = None,
    update: bool = True,
) -> DataFrame:
    """Saves the postings of a scored scan and lists everything saved that
    nobody has reviewed, best first. Without ``update`` only urls not saved yet
    are saved; newer versions of the others are left out."""
    spark = scan.sparkSession
    if not update:
        scan = new_postings(scan, list_postings(spark, store))
    save_postings(scan, store)
    return review_list(unreviewed(list_postings(spark, store), reviews), k)
