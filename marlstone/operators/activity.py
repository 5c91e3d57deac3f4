"""When series are active: by the interval of their samples, or by a sample in range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK_MS = 604_800_000


def overlap(start: int | None, end: int | None) -> Column:
    """min_t < end and max_t >= start; None is no bound."""
    out = F.lit(True)
    if end is not None:
        out = out & (F.col("min_t") < end)
    if start is not None:
        out = out & (F.col("max_t") >= start)
    return out


def active_overlap(series: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """tsid of the series whose interval meets [start, end)."""
    return series.where(overlap(start, end)).select("tsid")


def active_exact(samples: DataFrame, start: int, end: int) -> DataFrame:
    """tsid of the series with a sample in [start, end)."""
    return samples.where((F.col("t") >= start) & (F.col("t") < end)).select("tsid").distinct()


def epochs(samples: DataFrame, origin: int, length: int = WEEK_MS) -> DataFrame:
    """tsid, epoch, min_t, max_t: the series active in each epoch, with their times there."""
    epoch = F.floor((F.col("t") - origin) / F.lit(float(length))).alias("epoch")
    return samples.groupBy("tsid", epoch).agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))
