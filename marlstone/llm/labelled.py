"""Bounded labelled samples to fit classifiers on, and folds by a digest of the id.

The sample is a bounded number of labelled rows: at most ``PER_CLASS`` of each label and at most
half of ``FIT_BYTES`` of text of each label, in the order of a digest of the id; a row that would go over
the bytes is left out as a whole, and no text is cut. What the driver collects is bounded by the two.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Labelled rows of each class, and bytes of their texts together, that a classifier is fitted on at most.
PER_CLASS = 1500
FIT_BYTES = 16 << 20


def fold(doc_id: Column, n: int) -> Column:
    """The fold of an id: crc32 of its text, by ``n``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, n: int, out: int, per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, told, y, text): labelled rows whose fold by ``n`` isn't ``out``, within the bounds. Rows that repeat id and text repeat.

    The ids asked for and the rows chosen are at most twice ``per_class`` and are broadcast to the documents.
    """
    spark = docs.sparkSession
    known = pick(labels, id=id_col, y=label).where("id is not null and y in (0, 1)").where(fold(F.col("id"), n) != out).select("id", F.col("y").cast("int").alias("y")).distinct()
    order = [F.xxhash64("id"), F.col("id")]
    asked = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    rows = pick(docs, own=id_col, text=text_col).withColumn("told", F.xxhash64("text"))
    sizes = rows.join(F.broadcast(asked[0].unionByName(asked[1])), F.col("own") == F.col("id")).select("id", "y", "told", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct()
    chosen = []
    for y in (0, 1):
        left = fit_bytes // 2
        for r in sizes.where(F.col("y") == y).orderBy(*order, "told").limit(per_class).collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append((r["id"], r["told"], y))
    kind = dict(known.dtypes)["id"]
    some = spark.createDataFrame(chosen, f"id {kind}, mine long, y int")
    return rows.join(F.broadcast(some), (F.col("own") == F.col("id")) & (F.col("told") == F.col("mine"))).select("id", "told", "y", "text")


def measured(rows: DataFrame, of: Callable[[pa.Array], list[bytes]], step: int = 256) -> tuple[list[bytes], list[int]]:
    """What executors make of each sampled text, once for each row however often it repeats, and the labels; in one order, whatever the partitions."""
    from .common import slices

    def each(batches):
        for b in slices(batches, step):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("told"), b.column("y"), pa.array(of(b.column("text")), pa.binary())], ["id", "told", "y", "made"])

    kind = dict(rows.dtypes)["id"]
    made = rows.mapInArrow(each, f"id {kind}, told long, y int, made binary").groupBy("id", "told", "y").agg(F.first("made").alias("made")).select("y", "made").toArrow()
    y, things = made.column("y").to_pylist(), made.column("made").to_pylist()
    del made
    order = sorted(range(len(y)), key=lambda i: (y[i], things[i]))
    return [things[i] for i in order], [y[i] for i in order]
