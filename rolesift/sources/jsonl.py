"""Postings as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rolesift.schema import POSTING

#: The text of a line that is not valid JSON.
RAW_LINE = "raw_line"
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_json(
    spark: SparkSession, path: str, schema: T.StructType = POSTING, raw_line: str | None = RAW_LINE
) -> DataFrame:
    """The lines in the given schema, and in one more column, null for a good
    line, the text of a line that does not fit it. Its other fields are null
    where they could not be read, so validation rejects it and keeps the text;
    it does not end the job. Without ``raw_line`` that column is left out."""
    reader = spark.read.option("mode", "PERMISSIVE")
    # Times written elsewhere may have fewer digits, or none.
    reader = reader.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]")
    if raw_line:
        schema = T.StructType([*schema.fields, T.StructField(raw_line, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", raw_line)
    return reader.schema(schema).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Times keep their microseconds."""
    df.write.mode(mode).option("timestampFormat", TIMES).json(path)
