"""The values that labels have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_values(posting_rows: DataFrame, name: str) -> DataFrame:
    return posting_rows.where(F.col("name") == name).select("value").distinct()


def label_names(posting_rows: DataFrame) -> DataFrame:
    """All label names. An addition of this engine's own."""
    return posting_rows.select("name").distinct()


def label_value_counts(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("name", "value").agg(F.count("*").alias("n"))
