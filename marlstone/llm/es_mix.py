"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w``: ``u`` is a uniform number drawn from a digest
of its id, ``w`` its quality weight. The documents of a source, sorted by key, are a
weighted sample without replacement of any length. A source whose target is
``e`` times its size and a rest takes ``e`` complete epochs, then the documents in key order
while the prefix sum of their sizes, less half of the document's own, is within the rest:
the last document is in if that leaves the sum nearer the target.

The prefix sum is made in two steps, so that no task sorts a whole source: keys
are cut into ranges of their logarithm, of which none has more than 3 / ``B`` of a source, whatever the scale of its weights; sizes are summed by (source, range) before any shuffle; the
running sum over the ranges of a source is the start of each range, and rows are sorted only
within a range. A source of any share of the rows is spread over some B groups.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
null id draws as the empty string; rows that repeat draw the same key and count each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, pick, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: What a given weight that is null or not over 0 counts as: such documents come last.
LEAST_WEIGHT = 1e-9


def quality_weight(n_chars: Column, size: Column) -> Column:
    """A weight in (0, 1]: 1 for a mean word length, with its space, of 6 characters; less the further from it."""
    return F.when(size > 0, 1.0 / (1.0 + F.abs(n_chars / size - 6.0) / 6.0)).otherwise(1.0)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> with its target. One row for each source goes in and out.

    The targets are the water level at which ``weight * level``, cut at ``cap`` times the
    source's size, sums to ``share`` times all sizes: what resharing the excess by weight
    ends with. Cut sources are those with the least size by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("ratio", "source")
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sources.withColumn("weight", weigh).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    s = s.withColumn("cut_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("left", share * F.sum("source_size").over(every) - cap * F.col("cut_before"))
    s = s.withColumn("is_cut", F.col("ratio") * F.col("weight_left") <= F.col("left"))
    free = F.row_number().over(by_level)
    first = F.min(F.when(~F.col("is_cut"), F.col("at"))).over(every)
    s = s.withColumn("at", free).withColumn("first", first)
    level = {c: F.max(F.when(F.col("at") == F.col("first"), F.col(c))).over(every) for c in ("left", "weight_left")}
    s = s.withColumn("all_left", level["left"]).withColumn("all_weight", level["weight_left"])
    cut = F.col("first").isNull() | (F.col("at") < F.col("first"))
    return s.select("source", "source_size", F.when(cut, cap * F.col("source_size")).otherwise(F.col("weight") * F.col("all_left") / F.col("all_weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, weight_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``weight_col`` names a column of quality weights; without it ``quality_weight`` is used.
    """
    columns = {"doc_id": id_col, "text": text_col, "source": source_col} | ({"given": weight_col} if weight_col else {})
    text = F.coalesce(F.col("text"), F.lit(""))
    d = pick(docs, **columns).withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("long"))
    given = F.when(F.col("given") > 0, F.col("given").cast("double")).otherwise(LEAST_WEIGHT) if weight_col else None
    d = d.withColumn("w", given if weight_col else quality_weight(F.length(text), F.col("size")))
    hex13 = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13)
    u = (F.conv(hex13, 16, 10).cast("double") + 1.0) / float(2**52 + 1)
    rows = settle(d.select("doc_id", "source", "size", (-F.log(u) / F.col("w")).alias("key")))

    n = min(65_536, max(256, 16 * parts(docs.sparkSession)))
    # x exp(-x), the density of an exponential draw over its logarithm, is 0.37 at most.
    rows = rows.withColumn("range", F.floor(F.log(F.greatest(F.col("key"), F.lit(1e-300))) * (n / 8)))
    aim = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    start = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    starts = sums.withColumn("start", start).alias("l").join(aim.alias("r"), same).select("l.source", "l.range", "start", "source_size", "target")

    within = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("within", within).alias("l").join(starts.alias("r"), same & (F.col("l.range") == F.col("r.range")))
    placed = placed.select("doc_id", "l.source", "size", "source_size", "target", (F.col("start") + F.col("within")).alias("prefix"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("rest") > 0) & (2 * F.col("prefix") - F.col("size") <= 2 * F.col("rest"))
    placed = placed.withColumn("epochs", epochs).withColumn("rest", rest)
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.when(chosen, F.col("size")).otherwise(0)).cast("long").alias("taken"))
