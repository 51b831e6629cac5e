"""Text sources: ``id|text`` lines and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import import_id, import_text


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the lines that have both; texts may hold more bars."""
    return split_lines(spark.read.text(path))


def split_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(import_id(value).alias("id"), import_text(value).alias("text")).where("id <> '' AND text <> ''")


def vocabulary(spark: SparkSession, path: str, most: int = 1_000_000) -> dict[str, int]:
    """Token to 0-based line number. One small file, read in order; refused beyond ``most`` lines."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a vocabulary is one file")
    lines = rows[0].value.split("\n")
    if len(lines) > most:
        raise ValueError("vocabulary too large")
    return {token.rstrip("\r"): k for k, token in enumerate(lines) if token}


def keyed_by(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with an id like ``folder/note#3`` made of columns."""
    return rows.withColumn("id", F.concat_ws("#", *[F.col(c).cast("string") for c in columns]))
