"""Classes and flags of a posting, and the filters over them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import terms
from rolesift.functions import text as X

NO_CLASS = "other"


def _holds(rule: tuple) -> Column:
    """Whether a rule of the default table holds."""
    _, _, fields, term, _, unless, requires = rule
    if fields == "years":
        years = X.years_required(F.col("description"))
        return F.coalesce(years >= int(term), F.lit(False))
    parts = [[x for x in (p or "").split("|") if x] for p in (term, unless, requires)]
    return reduce(or_, [X.rule_holds(X.lowered(F.col(f)), *parts) for f in fields.split("|")])


def _any(rules: list[tuple]) -> Column:
    return reduce(or_, map(_holds, rules))


def _class(kind: str) -> Column:
    found = F
    for name, rules in terms.of_class(kind).items():
        found = found.when(_any(rules), name)
    return found.otherwise(NO_CLASS)


def _penalty(name: str) -> Column:
    return _any(terms.of_class("penalty", name)[name])


def _senior() -> Column:
    return _penalty("senior")


def _too_many_years() -> Column:
    return _penalty("many years")


def _unpaid() -> Column:
    return _penalty("unpaid")


def _contract_only() -> Column:
    return _penalty("contract only")


def role_class(df: DataFrame) -> DataFrame:
    """Adds ``role_class``: the target role the title names."""
    return df.withColumn("role_class", _class("role"))


def location_class(df: DataFrame) -> DataFrame:
    """Adds ``location_class``: the preferred location named, state first."""
    return df.withColumn("location_class", _class("location"))


def is_senior(df: DataFrame) -> DataFrame:
    """Adds ``is_senior``, read from the title only: "lead" and "staff" are
    ordinary words in a description."""
    return df.withColumn("is_senior", _senior())


def years_required(df: DataFrame) -> DataFrame:
    """Adds ``years_required`` (null if none is named) and ``many_years``."""
    return df.withColumn(
        "years_required", X.years_required(F.col("description"))
    ).withColumn(
        "many_years", F.coalesce(F.col("years_required") >= terms.SENIOR_YEARS, F.lit(False))
    )


def is_unpaid(df: DataFrame) -> DataFrame:
    """Adds ``is_unpaid``, read from title and description; "unpaid leave" and
    the like are not an unpaid role."""
    return df.withColumn("is_unpaid", _unpaid())


def is_contract_only(df: DataFrame) -> DataFrame:
    """Adds ``is_contract_only``, read from title and description;
    "contract-to-hire" is not contract-only."""
    return df.withColumn("is_contract_only", _contract_only())


def not_entry_level(df: DataFrame) -> DataFrame:
    return df.withColumn("not_entry_level", _senior() | _too_many_years())


def junior_friendly(df: DataFrame) -> DataFrame:
    """Keeps postings without a senior title or many years. A title without
    any level word stays."""
    return df.filter(~(_senior() | _too_many_years()))


def drop_disqualified(df: DataFrame) -> DataFrame:
    """Keeps postings without any disqualifying signal."""
    return df.filter(~(_senior() | _unpaid() | _contract_only() | _too_many_years()))
