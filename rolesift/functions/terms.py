"""The default rules. One table feeds the scores, the classes and the flags."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from rolesift.schema import CONDITIONAL_RULE

SENIOR_YEARS = 5
STRONG_FIT = 15

NEARBY = (
    "minnesota|mn|twin cities|minneapolis|saint paul|st paul|rochester"
)
# Places of the same name elsewhere.
ELSEWHERE = "rochester new york|rochester ny|rochester new hampshire|rochester nh"
UNPAID_TIME = (
    "unpaid leave|unpaid parental leave|unpaid family leave|unpaid medical leave|"
    "unpaid time off|unpaid break|unpaid breaks|unpaid lunch|unpaid overtime"
)

# Rule id, kind, class, field, term, weight, unless, requires.
#
# A rule holds when one of its terms stands in one of its fields, as whole words
# in that order, apart from what stands inside one of the phrases of ``unless``,
# and when one of the phrases of ``requires``, if there are any, stands there as
# well (``=x``: the field says x and nothing else). Alternatives are divided by
# "|". A rule on the field "years" holds when that many years or more are
# required. The class names what the rule stands for; the first that holds names
# the class of a posting.
TERMS = [
    ("role_junior", "role", "junior software engineer", "title",
     "junior software engineer|jr software engineer", 10, None, None),
    ("role_newgrad", "role", "new grad software engineer", "title",
     "new grad software engineer|new graduate software engineer", 10, None, None),
    ("role_entry", "role", "entry-level software developer", "title",
     "entry level software developer|entry level software engineer", 10, None, None),
    ("role_app", "role", "application developer", "title",
     "application developer|applications developer", 10, None, None),
    ("role_fe", "role", "frontend developer", "title",
     "frontend developer|front end developer|frontend engineer|front end engineer", 10, None, None),
    ("role_fs", "role", "full-stack developer", "title",
     "full stack developer|fullstack developer|full stack engineer|fullstack engineer", 10,
     None, None),
    ("role_java", "role", "java developer", "title", "java developer", 10, None, None),
    ("role_react", "role", "react / typescript developer", "title", "react", 10, None, None),
    ("role_ts", "role", "react / typescript developer", "title", "typescript", 10, None, None),
    ("role_aws", "role", "junior aws or cloud", "title", "junior aws|jr aws", 10, None, None),
    ("role_cloud", "role", "junior aws or cloud", "title", "junior cloud|jr cloud", 10, None, None),
    ("loc_mn", "location", "minnesota", "location", "minnesota|mn", 5, None, None),
    ("loc_tc", "location", "twin cities", "location",
     "twin cities|minneapolis|saint paul|st paul", 5, None, None),
    ("loc_roc", "location", "rochester", "location", "rochester", 5, ELSEWHERE, None),
    ("loc_hybrid", "location", "hybrid", "location", "hybrid", 5, ELSEWHERE, f"=hybrid|{NEARBY}"),
    ("loc_remote", "location", "remote", "location", "remote", 5, None, None),
    ("pen_senior", "penalty", "senior", "title", "senior|sr|snr", -20, None, None),
    ("pen_staff", "penalty", "senior", "title", "staff", -20, None, None),
    ("pen_principal", "penalty", "senior", "title", "principal", -20, None, None),
    ("pen_lead", "penalty", "senior", "title", "lead", -20, None, None),
    ("pen_arch", "penalty", "senior", "title", "architect", -20, None, None),
    ("pen_mgr", "penalty", "senior", "title", "manager", -20, None, None),
    ("pen_unpaid", "penalty", "unpaid", "title|description", "unpaid", -20, UNPAID_TIME, None),
    ("pen_contract", "penalty", "contract only", "title|description", "contract only", -20,
     None, None),
    ("pen_years", "penalty", "many years", "years", str(SENIOR_YEARS), -20, None, None),
]

DEFAULT_RULES = [(i, kind, field, term, w, u, r) for i, kind, _, field, term, w, u, r in TERMS]


def of_class(kind: str, name: str | None = None) -> dict[str, list[tuple]]:
    """The rules of a kind by class, in the table's order."""
    classes: dict[str, list[tuple]] = {}
    for rule, row in zip(DEFAULT_RULES, TERMS):
        if row[1] == kind and name in (None, row[2]):
            classes.setdefault(row[2], []).append(rule)
    return classes


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Rules as a table that Spark holds in its plan, so its size is known.
    Rows may end after the weight."""
    names = CONDITIONAL_RULE.names
    rows = [dict.fromkeys(names) | dict(zip(names, rule)) for rule in rules]
    table = pa.Table.from_pylist(rows, to_arrow_schema(CONDITIONAL_RULE))
    return spark.createDataFrame(table, CONDITIONAL_RULE)


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_table(spark, DEFAULT_RULES)
