"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join on the node, so a
node with a third of all edges is summed up map-side and its join is one
that Spark can split. Every step's edges are written to the shared folder. Nothing is
collected but two numbers a round. A caller may have few edges joined in one task instead: there a round's
plans and tasks weigh more on the driver than the edges do on an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

#: Edges that one task may join: 1 MB.
FEW = 1 << 16


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (node, root) of each node but the roots."""
    kept = [np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]) for b in batches if b.num_rows]
    if not kept:
        return
    nodes, ends = np.unique(np.concatenate(kept), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in ends.reshape(-1, 2).tolist():
        i, j = find(a), find(b)
        root[max(i, j)] = min(i, j)
    least = np.array([find(i) for i in range(len(nodes))], np.int64)
    own = least != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[least[own]])], ["node", "root"])


def _star(pairs: DataFrame, keep: F.Column) -> DataFrame:
    """For each node u of ``pairs`` (u, v): v -> the least of u and its neighbours, where ``keep`` holds."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60, settled: bool = True, few: int = 0) -> DataFrame:
    """(a, b) long -> (node, root): root is the least node of its component. Nodes without an edge don't appear. Up to ``few`` edges are joined in one task.

    With ``settled=False``, after two rounds: a root is some lesser node of the component, and a node may have several.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if few and now.count() <= few:
        out = settle(now.coalesce(1).mapInArrow(_joined, "node long, root long"))
        forget(now)
        return out
    said = None
    for _ in range(most):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        before, now = now, settle(_star(down, F.lit(True)))
        forget(before)
        if not settled:
            if said:
                return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            said = (0,)
            continue
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == said:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        said = tuple(row)
    raise RuntimeError(f"components: not settled after {most} rounds")
