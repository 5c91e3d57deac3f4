"""Samples of the series that matchers choose. Sample ranges include both ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..model import Matcher
from .resolve import resolve


def select_series(series: DataFrame, samples: DataFrame, matchers: Sequence[Matcher], mint: int, maxt: int, **how) -> DataFrame:
    """tsid, t, v with mint <= t <= maxt. The index is asked for [mint, maxt + 1): a series whose only sample is at maxt counts."""
    tsids = resolve(series, matchers, mint, maxt + 1, **how)
    return samples.where(F.col("t").between(mint, maxt)).join(tsids, "tsid", "left_semi").select("tsid", "t", "v")


def series_with_labels(series: DataFrame, samples: DataFrame, matchers: Sequence[Matcher], mint: int, maxt: int, **how) -> DataFrame:
    """As ``select_series``, with labels, which are joined last."""
    return select_series(series, samples, matchers, mint, maxt, **how).join(series.select("tsid", "labels"), "tsid")


def seek(samples: DataFrame, t: int) -> DataFrame:
    """The samples at ``t`` or later, by series and time."""
    return samples.where(F.col("t") >= t).orderBy("tsid", "t")


def grouped(samples: DataFrame) -> DataFrame:
    """tsid, samples: each series with its samples in order of time."""
    return samples.groupBy("tsid").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("samples"))


def iterate(samples: DataFrame) -> Iterator[tuple[int, list[Row]]]:
    """Series one by one, each with its samples in order, a partition at a time on the driver."""
    now, held = None, []
    for row in samples.orderBy("tsid", "t").toLocalIterator():
        if row["tsid"] != now and held:
            yield now, held
            held = []
        now = row["tsid"]
        held.append(row)
    if held:
        yield now, held
