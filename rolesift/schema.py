"""Fixed schemas. Every reader uses one of these; nothing is inferred."""

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

POSTING = T.StructType(
    [
        T.StructField("posting_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
    ]
)

SCORED = T.StructType(
    POSTING.fields
    + [
        T.StructField("score", T.LongType()),
        T.StructField("matched_rules", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("field", T.StringType(), False),
        T.StructField("term", T.StringType(), False),
        T.StructField("weight", T.IntegerType(), False),
    ]
)

#: Rules may carry conditions; see ``functions/terms.py``.
CONDITIONAL_RULE = T.StructType(
    RULE.fields
    + [
        T.StructField("unless", T.StringType()),
        T.StructField("requires", T.StringType()),
    ]
)

OUTBOX = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("matched_rules", T.StringType()),
    ]
)
