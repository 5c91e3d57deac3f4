"""The registry: each label set once, with a dense number.

Numbers are given without one task seeing all rows: keys are dealt by ranges, numbered within a
range, and each range starts where those before it end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import clean_labels, label_key, literal_map
from ..functions.storage import settle
from ..model import label_set

_WITHIN = (1 << 33) - 1


def label_order(names: Sequence[str]) -> list[Column]:
    """An order of series by these labels, absent ones first."""
    return [F.col("labels")[n].asc_nulls_first() for n in names]


def number(rows: DataFrame, order: Sequence[Column] = (), start: int = 0) -> DataFrame:
    """``rows`` with tsid: 1, 2, ... above ``start`` in ``order`` (by key if none is given)."""
    order = list(order) or [F.col("key")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = settle(dealt)  # the ranges must be the same for their sizes and for their rows
    part = F.shiftright("place", 33)
    # One row for each range.
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.broadcast(sizes.select("part", before.alias("before")))
    tsid = F.col("before") + F.col("place").bitwiseAND(F.lit(_WITHIN)) + 1 + start
    return dealt.withColumn("part", part).join(begins, "part").withColumn("tsid", tsid).select("tsid", *rows.columns)


def keyed(samples: DataFrame) -> DataFrame:
    """``samples`` (labels, ...) with the canonical key of each label set; labels without a value are absent."""
    return samples if "key" in samples.columns else samples.withColumn("key", label_key(clean_labels(F.col("labels"))))


def label_sets(samples: DataFrame) -> DataFrame:
    """(labels, t, ...) -> key, labels, min_t, max_t: each label set once, with the times it was seen. Rows without a label set have none."""
    own = keyed(samples).where("labels is not null")
    return own.groupBy("key").agg(clean_labels(F.any_value("labels")).alias("labels"), F.min("t").alias("min_t"), F.max("t").alias("max_t"))


def build(samples: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """A registry of all label sets of ``samples``: tsid, key, labels, min_t, max_t."""
    return number(label_sets(samples), order)


def existing(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """The label sets of ``batch`` (labels, t) that the registry has, with their tsid: what a second registration gives."""
    seen = label_sets(batch)
    return seen.join(registry.select("key", "tsid"), "key").select("tsid", "key", "labels", "min_t", "max_t")


def new(registry: DataFrame, batch: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """The label sets of ``batch`` that the registry lacks, numbered on from its last."""
    last = registry.agg(F.max("tsid")).first()[0] or 0
    return number(label_sets(batch).join(registry.select("key"), "key", "left_anti"), order, last)


def register(registry: DataFrame, batch: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Get or create: tsid, key, labels, min_t, max_t, inserted, for each label set of ``batch``."""
    return existing(registry, batch).withColumn("inserted", F.lit(False)).unionByName(new(registry, batch, order).withColumn("inserted", F.lit(True)))


def key_of(labels: Mapping[str, str]) -> Column:
    """The key of a label set, a constant."""
    return label_key(literal_map(label_set(labels)))


def exists(registry: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """The tsid of just this label set; no row if it isn't registered."""
    return registry.where(F.col("key") == key_of(labels)).select("tsid")


def series_labels(registry: DataFrame, tsid: int) -> DataFrame:
    """The labels of one series, as (name, value); no row if it isn't known."""
    return registry.where(F.col("tsid") == tsid).select(F.explode("labels").alias("name", "value"))


def current_tsid(registry: DataFrame) -> DataFrame:
    """The next number."""
    return registry.agg((F.coalesce(F.max("tsid"), F.lit(0)) + 1).alias("next_tsid"))


def attach(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """(labels, t, v) -> tsid, t, v."""
    return keyed(samples).select("key", "t", "v").join(registry.select("key", "tsid"), "key").select("tsid", "t", "v")
