"""File sources and sinks: headerless text tables, JSON lines with bad rows, column groups in Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_positional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headerless table of trimmed strings; an empty field is an empty string."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=False, emptyValue="", nullValue="\0")
    return rows.select(*(F.trim(c).alias(c) for c in columns))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON-lines file that can be read by the schema; the others are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_tolerant_lines(spark: SparkSession, path: str, fields: int) -> DataFrame:
    """Comma-separated lines with so many fields or more, as the array parts."""
    return spark.read.text(path).select(F.split("value", ",").alias("parts")).where(F.size("parts") >= fields)


def write_groups(df: DataFrame, path: str, split: str) -> None:
    """Parquet in one folder for each value of split; the rows of a split stay spread over their tasks."""
    df.write.partitionBy(split).parquet(path)


def read_groups(spark: SparkSession, path: str, split: str, value: str, prefixes: list[str]) -> DataFrame:
    """Columns with these prefixes of one split; other splits and columns are not read."""
    rows = spark.read.parquet(path).where(F.col(split) == value)
    return rows.select(*(c for c in rows.columns if any(c.startswith(p) for p in prefixes)))


def read_header_csv(spark: SparkSession, path: str, schema: str, needed: str) -> DataFrame:
    """A table with a header by a schema, without the rows that lack the needed column."""
    return spark.read.schema(schema).csv(path, header=True).where(F.col(needed).isNotNull())


def coerce_nested(value: Column, schema: str) -> Column:
    """A struct from a text that is JSON, with double or single quotes around names and values; the other kind may be inside."""
    return F.from_json(value, schema, {"allowSingleQuotes": "true"})
