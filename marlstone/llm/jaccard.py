"""Near-duplicates by SimHash, checked by the Jaccard similarity of word shingles; an exact prefix join finds what the fingerprints miss.

1. A text is the set of the XXH64 hashes of its five-word shingles. Equal sets are one class from here on.
2. A class's fingerprint is the bitwise majority of its hashes. ``simhash.links`` finds the fingerprints within ``RADIUS`` bits by
   segment bit counts and grids; the classes of linked fingerprints are pairs to check.
3. Similar sets may have fingerprints farther apart (about 10 bits at 4/5), so an exact way finds the rest. Shingles have one global order: those seldom seen first. The counts come from a sample, which
   moves only the cost: any one order gives the same pairs. Two sets with similarity 4/5 or more share a
   shingle among the first ``n - ceil(4 n / 5) + 1`` of each, so each set is dealt to the cells of those.
4. The pairs of the fingerprints, and of each class with the least classes of up to ``SEEDS`` of its cells, are checked. The links
found put classes under roots, and then all pairs of a cell whose roots differ are compared. Pairs that
their sizes, their places in the order, or their sketches rule out are left out, small sketches in the cell and wide ones before sets are joined; all others are checked on the
whole sets. A sketch has the parity of the set's hashes in each residue: two sketches never differ in more bits
than the sets have shingles apart, so no similar pair is ruled out.
5. Components of the links.

Defined cases: lower-cased like ``simhash``; fewer words than a shingle are one shingle; null and wordless texts are
one class; shingles count once; a null id is never a component's id unless all its ids are null; an id on
different texts stands for each; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, by_place, forget, null_safe, parts, pick, place, raw_texts, renamed, row_digest, settle, shared_table, slices
from .components import FEW, components
from .simhash import SEED, _runs, _signed, fingerprint_of, fixed_for
from .simhash import links as linked_fingerprints

SHINGLE = 5
#: The least similarity, as a fraction.
UP, DOWN = 4, 5
#: One class in so many is counted for the order of shingles, and the most shingles that the order puts last.
SAMPLE, FREQUENT = 16, 1 << 16
#: Bits that fingerprints may differ in, and how many strangers in a cell of their grids cost as much as one row more.
RADIUS, STRANGERS = 5, 512
#: Classes that a class is compared with before all others.
SEEDS = 4
#: Pairs that a task gives at once.
PAIRS = 1 << 18
#: Bits of a sketch, and the residues by which the rows of pairs' classes are found before they are joined.
BITS, RESIDUES = 512, 1 << 22
WORDS = BITS // 64


def shingles(body: bytes, width: int = SHINGLE) -> np.ndarray:
    """The hashes of a lower-cased text's shingles, each once, in order."""
    out, hashed = [], xxhash.xxh64_intdigest
    for words in _runs(body, width):
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: max(len(words) - width + 1, 1)]
        out.append(np.fromiter([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)], np.uint64, len(starts)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * both >= UP * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the set's hashes in each of ``BITS`` residues, as ``WORDS`` numbers: two differ in no more bits than the sets have shingles apart."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes:
    """A sketch of as many bits as the set has shingles, about, so that it tells large sets apart too; it folds to any lesser one."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """How many shingles two wide sketches' sets have apart, at least."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, told (the text's digest), cls (the set's digest), the set's fingerprint, its sketches and the set, of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            every = [shingles(t.translate(LOWER)) for t in raw_texts(b.column("text"))]
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in every], np.uint64).view(np.int64)
            own = [pa.array(cls), pa.array([_signed(fingerprint_of(s)) for s in every], pa.int64()), pa.array([sketch(s) for s in every], pa.list_(pa.int64())), pa.array([len(s) for s in every], pa.int64()), pa.array([wide_sketch(s) for s in every], pa.binary()), pa.array([s.tobytes() for s in every], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("told"), *own], ["doc_id", "told", "cls", "fp", "sketch", "size", "wide", "shingles"])

    return pick(docs, doc_id=id_col, text=text_col).withColumn("told", told(F.col("text"))).mapInArrow(of, "doc_id long, told long, cls long, fp long, sketch array<long>, size long, wide binary, shingles binary")


def told(text: Column) -> Column:
    return F.xxhash64(text)


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count), by shingle, of the most frequent of a sample of the classes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_sets_of(b.column("shingles"))).view(np.int64))], ["s"])

    some = rows.where(F.pmod("cls", F.lit(SAMPLE)) == 0).select("shingles").mapInArrow(of, "s long")
    top = some.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    s, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def first_of(s: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set that one of any similar set's is among, in order."""
    if not len(s):
        return s
    rank = np.zeros(len(s), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], s), len(often[0]) - 1)
        rank = np.where(often[0][at] == s, often[1][at], 0)
    return s[np.lexsort((s, rank))[: len(s) - -(-UP * len(s) // DOWN) + 1]]


def _cells(rows: DataFrame) -> DataFrame:
    """(cell, cls, n, at): the classes of cells with more than one; n is the set's size, at the shingle's place in it. And least, least_n: the least class."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent(rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            every = _sets_of(b.column("shingles"))
            some = [first_of(s, sent.value) for s in every]
            k = [len(x) for x in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(some).view(np.int64)), pa.array(np.repeat(b.column("cls").to_numpy(zero_copy_only=False), k)), pa.array(np.repeat([len(s) for s in every], k).astype(np.int64)), pa.array(np.concatenate([np.arange(x) for x in k]).astype(np.int64))],
                ["cell", "cls", "n", "at"],
            )

    def meet(cell: np.ndarray) -> np.ndarray:
        cls, n, _ = cell[:, 1], cell[:, 2], cell[:, 3]
        kept = np.concatenate(([True], cls[1:] != cls[:-1]))
        if kept.sum() < 2:
            return np.empty((0, 6), np.int64)
        return np.column_stack([cell[kept], np.full(kept.sum(), cls[0]), np.full(kept.sum(), n[0])])

    names = ["cell", "cls", "n", "at", "least", "least_n"]
    dealt = rows.select("cls", "shingles").mapInArrow(deal, "cell long, cls long, n long, at long")
    return _by_cell(dealt, ["cell", "cls", "n", "at"], lambda cell: [meet(cell)], names)


def _by_cell(df: DataFrame, columns: list[str], of, names: list[str]) -> DataFrame:
    """The rows that ``of`` makes of each cell's, all numbers; ``columns`` starts with the cell and the order within it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(names))], names)

        def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
            more = ends - starts > 1
            found, n = [], 0
            for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                for got in of(rows[s:e]):
                    found.append(got)
                    n += len(got)
                    if n > PAIRS:
                        yield batch(found)
                        found, n = [], 0
            if n:
                yield batch(found)

        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            begins = np.flatnonzero(new[:, 0] != new[-1, 0])
            upto = int(begins[-1]) + 1 if len(begins) else 0
            if upto or (held and held[-1][-1, 0] != new[0, 0]):
                yield from give(np.concatenate([*held, new[:upto]]))
                held = []
            held.append(new[upto:])
        if held:
            yield from give(np.concatenate(held))

    n = parts(df.sparkSession)
    return df.select(*columns).repartition(n, "cell").sortWithinPartitions(*columns[:2]).mapInArrow(each, ", ".join(f"{c} long" for c in names))


def _possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m, whose first common shingle stands at these places, can be similar."""
    sizes = (DOWN * np.minimum(n, m) >= UP * np.maximum(n, m))
    return sizes & ((UP + DOWN) * (np.minimum(n - at, m - bt)) >= UP * (n + m))


def _across(cell: np.ndarray) -> Iterator[np.ndarray]:
    """cell, root, cls, n, at, sketch by root -> pairs of classes of different roots that can be similar."""
    root = cell[:, 1]
    opens = np.concatenate(([0], np.flatnonzero(root[1:] != root[:-1]) + 1, [len(root)]))
    largest = int(np.argmax(np.diff(opens)))
    # The largest component's classes stand last, so that each other class is held against what follows its component.
    order = np.concatenate([np.arange(opens[k], opens[k + 1]) for k in [*[k for k in range(len(opens) - 1) if k != largest], largest]])
    _, root, cls, n, at, *_ = cell[order].T
    bits = np.ascontiguousarray(cell[order, 5:]).view(np.uint64)
    ends = np.concatenate((np.flatnonzero(root[1:] != root[:-1]) + 1, [len(root)]))
    after = ends[np.searchsorted(ends, np.arange(len(root)), side="right")]
    for i in range(int(ends[-2]) if len(ends) > 1 else 0):
        j = int(after[i])
        near = j + np.flatnonzero(_possible(n[i], at[i], n[j:], at[j:]))
        if len(near):
            apart = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = near[(UP + DOWN) * apart <= (DOWN - UP) * (n[near] + n[i])]
            yield np.column_stack([np.minimum(cls[near], cls[i]), np.maximum(cls[near], cls[i])])


def _checked(pairs: DataFrame, rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those (a, b) whose sets are similar: by wide sketches first, then by the sets of what is left."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            least = np.array([apart(x, y) for x, y in zip(b.column("a_wide").to_pylist(), b.column("b_wide").to_pylist(), strict=True)])
            good = (UP + DOWN) * least <= (DOWN - UP) * (b.column("a_size").to_numpy() + b.column("b_size").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = [similar(x, y) for x, y in zip(_sets_of(b.column("x")), _sets_of(b.column("y")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    told = pairs.distinct()
    for side in ("a", "b"):
        told = told.join(sketches.select(F.col("cls").alias(side), F.col("size").alias(f"{side}_size"), F.col("wide").alias(f"{side}_wide")), side)
    left = settle(told.mapInArrow(close, "a long, b long"))
    needed = left.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    # Most rows go before the join, so that their sets aren't shuffled. At most RESIDUES numbers reach the driver.
    asked = np.zeros(RESIDUES, bool)
    asked[left.select(F.explode(F.array(*[F.pmod(c, F.lit(RESIDUES)).cast("int") for c in ("a", "b")])).alias("r")).distinct().toArrow().column("r").to_numpy()] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(asked))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column("cls").to_numpy() % RESIDUES
            yield b.filter(pa.array((sent.value[r >> 3] >> (7 - (r & 7)).astype(np.uint8) & 1).astype(bool)))

    # A class's rows have one and the same set.
    kept = shared_table(rows.select("cls", "shingles").mapInArrow(some, "cls long, shingles binary").join(needed, "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("set")), "sets")
    both = left.join(kept.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(kept.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    out = settle(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"))
    forget(left, kept)
    return out


def near_fingerprints(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of different classes, not yet checked, that connect all whose fingerprints are equal or linked within ``RADIUS``."""
    classes = rows.select("cls", "fp").distinct()
    least = settle(classes.groupBy("fp").agg(F.min("cls").alias("cls")))
    found = linked_fingerprints(least.select("fp"), RADIUS, fixed_for(least.count() // STRANGERS, RADIUS))
    ends = [least.select(F.col("fp").alias(x), F.col("cls").alias(f"{x}_cls")) for x in ("a", "b")]
    linked = found.distinct().join(ends[0], "a").join(ends[1], "b").select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))
    same = classes.join(least.withColumnRenamed("cls", "a"), "fp").where("a <> cls").select("a", F.col("cls").alias("b"))
    out = settle(linked.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    forget(least)
    return out


def links(rows: DataFrame) -> DataFrame:
    """(a, b): links between different classes of ``rows``, as ``sets`` has them, that connect all that are similar."""
    near = near_fingerprints(rows)
    cells = shared_table(_cells(rows), "cells")
    near_sizes = F.lit(DOWN) * F.least("n", "least_n") >= F.lit(UP) * F.greatest("n", "least_n")
    # The least classes of some of its cells stand for what a class meets there.
    met = cells.where((F.col("cls") != F.col("least")) & near_sizes).select(F.col("cls").alias("b"), F.col("least").alias("a"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a"), "a"))
    asked = met.repartition(parts(rows.sparkSession), "b").distinct().withColumn("nth", nth).where(F.col("nth") <= SEEDS).select("a", "b")
    # Sketches go with the classes of shared cells only.
    sketches = shared_table(rows.select("cls", "sketch", "size", "wide").join(cells.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "sketches")
    first = _checked(near.unionByName(asked), rows, sketches)
    roots = components(first, settled=False, few=FEW).groupBy("node").agg(F.min("root").alias("root")).withColumnRenamed("node", "cls")
    own = sketches.select("cls", "sketch").join(roots, "cls", "left")
    words = [F.col("sketch")[k].alias(f"s{k}") for k in range(WORDS)]
    rooted = cells.select("cell", "cls", "n", "at").join(settle(own), "cls").select("cell", F.coalesce("root", "cls").alias("root"), "cls", "n", "at", *words)
    second = _checked(_by_cell(rooted, ["cell", "root", "cls", "n", "at", *[f"s{k}" for k in range(WORDS)]], _across, ["a", "b"]), rows, sketches)
    forget(near, cells, sketches)
    return first.unionByName(second)


def near_dups(rows: DataFrame) -> DataFrame:
    """``rows``, as ``sets`` has them -> cls, root: the least class that links lead to, of each class."""
    roots = components(links(rows), few=FEW).withColumnRenamed("node", "cls")
    return rows.select("cls").distinct().join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: one with its least id."""
    safe = by_place(docs)
    at_id, at_text = f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"
    rows = settle(sets(docs, id_col, text_col))
    named = rows.select("doc_id", "told", "cls").join(near_dups(rows), "cls")
    one = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "told")).alias("one"))
    kept = one.select(*null_safe(F.col("one.doc_id")), F.col("one.told").alias("told"))
    # The number of a repeated row needs the rows dealt just as the join does.
    nth = F.row_number().over(Window.partitionBy("some_id", "no_id", "told").orderBy(row_digest(safe)))
    found = safe.select("*", *null_safe(F.col(at_id)), told(F.col(at_text)).alias("told")).join(kept, ["some_id", "no_id", "told"]).withColumn("nth", nth).where("nth = 1")
    return renamed(found, docs.columns)
