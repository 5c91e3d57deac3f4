"""From matchers and a time range to series, in three ways that give the same answer.

``map`` tests the label map of each registered series: best for small registries, whose scan is cheap.
``postings`` reads posting rows, in which the label's name and most values prune files; each pattern is tested
once for each distinct value; the lists are then counted by series. ``bitmap`` does the same on bitmaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Matcher
from ..plans.matchers import absent_passes, compile_matchers, value_test
from .activity import overlap
from .postings import bitmap_and, bitmap_or, bitmap_tsids, bitmaps, postings

STRATEGIES = ("map", "postings", "bitmap")


def resolve(series: DataFrame, matchers: Sequence[Matcher], start: int | None = None, end: int | None = None, neq_absent: str = "pass", strategy: str = "map", posting_rows: DataFrame | None = None) -> DataFrame:
    """tsid of the series of (tsid, labels, min_t, max_t) that all matchers pass and whose interval meets [start, end)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    if strategy == "map" or not matchers:
        return series.where(overlap(start, end)).where(compile_matchers(matchers, lambda n: F.col("labels")[n], neq_absent)).select("tsid")
    rows = (postings(series) if posting_rows is None else posting_rows).where(overlap(start, end))
    return by_index(rows, None, matchers, neq_absent, strategy)


def by_index(rows: DataFrame, maps: DataFrame | None, matchers: Sequence[Matcher], neq_absent: str = "pass", strategy: str = "postings") -> DataFrame:
    """tsid of the series that all matchers, one or more, pass. Each posting is in ``rows`` (name, value, tsid) or, as a bit, in ``maps`` (name, value, bucket, bits)."""
    need = [m for m in matchers if not absent_passes(m, matchers, neq_absent)]
    bar = [m for m in matchers if absent_passes(m, matchers, neq_absent)]
    asks = lambda ms, test: reduce(lambda a, b: a | b, [(F.col("name") == m.name) & test(m) for m in ms])
    passed = lambda m: value_test(m, F.col("value"))
    if strategy == "bitmap":
        out = _by_bitmaps(rows, maps, need)
    else:
        named = F.col("name").isin(sorted({m.name for m in need}))
        # Which of the matchers each distinct label value passes: one bit a matcher.
        passes = reduce(lambda a, b: a.bitwiseOR(b), [F.when((F.col("name") == m.name) & passed(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, m in enumerate(need)])
        values = rows.where(named).select("name", "value").distinct().withColumn("passed", passes).where("passed > 0")
        hits = rows.where(named).join(values, ["name", "value"]).select("tsid", "passed")
        if maps is not None:
            hits = hits.unionByName(bitmap_tsids(maps.where(asks(need, passed)).select("bucket", "bits", passes.alias("passed")), "passed"))
        # A series has one value for each name, so its bits never meet twice.
        out = hits.groupBy("tsid").agg(F.bit_or("passed").alias("all")).where(F.col("all") == (1 << len(need)) - 1).select("tsid")
    if bar:
        barred = asks(bar, lambda m: F.col("value") == m.value)
        those = rows.where(barred).select("tsid")
        out = out.join(those if maps is None else those.unionByName(bitmap_tsids(maps.where(barred))), "tsid", "left_anti")
    return out.select("tsid")


def _by_bitmaps(rows: DataFrame, maps: DataFrame | None, need: Sequence[Matcher]) -> DataFrame:
    def one(m: Matcher) -> DataFrame:
        asked = (F.col("name") == m.name) & value_test(m, F.col("value"))
        out = bitmaps(rows.where(asked).withColumn("one", F.lit(1)), "one").select("bucket", "bits")
        return out if maps is None else bitmap_or(out.unionByName(maps.where(asked).select("bucket", "bits")))

    return bitmap_tsids(bitmap_and(reduce(DataFrame.unionByName, map(one, need)), len(need)))
