"""The ``events`` table as time series: three label sets of rising detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_map
from ..functions.storage import settle
from ..model import NAME
from ..operators import registry

METRIC = "events_value"
#: The labels of each set, besides the name, in the order that numbers series.
SETS = {"F1": ("event_type", "user_id"), "F2": ("event_type", "user_id", "k"), "F3": ("event_type", "user_id", "band")}


def sample_rows(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    """t, v and the label columns of each event of ``table``, which may be a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    band = F.when(F.col("value") < 50, "low").when(F.col("value") < 150, "mid").otherwise("high")
    table = spark.read.parquet(f"{sf_dir}/events.parquet") if table is None else table
    return table.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        F.col("value").alias("v"),
        "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") == "purchase", band).alias("band"),
    )


def labelled(rows: DataFrame, which: str) -> DataFrame:
    """labels, t, v of label set ``which``."""
    columns = {NAME: F.lit(METRIC)} | {n: F.col(n) for n in SETS[which]}
    return rows.select(label_map(columns).alias("labels"), "t", "v")


def samples(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return labelled(sample_rows(spark, sf_dir), which)


_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def series(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """The registry of label set ``which``, built once a session."""
    at = (spark.sparkContext.applicationId, sf_dir, which)
    if at not in _BUILT:
        _BUILT[at] = settle(registry.build(samples(spark, sf_dir, which), registry.label_order(SETS[which])))
    return _BUILT[at]


def numbered(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """tsid, t, v of all samples."""
    return registry.attach(samples(spark, sf_dir, which), series(spark, sf_dir, which))
