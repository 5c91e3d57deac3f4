"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

1. A document's fingerprint is the bitwise majority of the XXH64 hashes of its
   word shingles. Equal fingerprints are one class from here on.
2. A fingerprint is cut into 32 segments of 2 bits; its embedding is the vector of the
   segments' bit counts, each 0, 1 or 2. Written in unary (00, 01, 11) it fits a
   64-bit word again, and the Manhattan distance of two vectors is the number of differing
   bits of their words. It is never over the number of differing bits of the fingerprints.
3. The grid: the 32 coordinates form ``radius + f`` blocks. Vectors within Manhattan distance ``radius`` differ in
   at most that many blocks, so they agree in at least one choice of ``f`` blocks. Each of the
   choices is a grid; its cells are the values of the chosen coordinates, and pairs within
   the radius meet in a cell of at least one grid, whatever ``f`` is. A fingerprint has one row in each grid, shuffled once
   by cell, however many share the cell. ``f`` follows the number of fingerprints: with more blocks fixed a fingerprint has more rows, but a cell fewer
   strangers (a coordinate of a random fingerprint tells 1.4 bits), so that pairs don't grow with the square.
4. In each cell with more than one, pairs are cut by Manhattan distance, then verified by the
   differing bits. A task gives a spanning forest of the links it finds, not the links: a
   cell where all are near each other makes no more rows than it has members. A cell over ``BLOCK`` members is cut, in its
   task, by grids of its own over the coordinates that its members differ in, as often as that halves the pairs at least; what is
   left is searched from each member for those that none has reached.
5. Components of the forests.

Defined cases: a null or wordless text has fingerprint 0, linked like any other; fewer words
than a shingle are one shingle; shingles count as often as they occur; a null id is never
a component's id unless all its ids are null; repeated rows count as two documents; an empty
table gives an empty result; further columns are ignored by ``near_dups`` and kept
by ``keep_one``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, by_place, null_safe, parts, pick, place, raw_texts, renamed, row_digest, settle, slices
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Bytes of a text that are hashed together.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Members of a cell up to which all its pairs are compared with those of other cells at once, and up to which it has no grids of its own.
SMALL, BLOCK = 64, 1 << 15
#: Blocks of coordinates that a cell of the grids fixes, at least and at most.
FIXED, MOST_FIXED = 3, 9


def fingerprint(body: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, lower-cased."""
    counts, total = np.zeros(64, np.int64), 0
    for words in _runs(body, width):
        n = max(len(words) - width + 1, 1)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashed = xxhash.xxh64_intdigest
        hashes = np.fromiter([hashed(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)], np.uint64, n)
        counts += _bit_counts(hashes)
        total += n
    return _majority(counts, total)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles' hashes."""
    return _majority(_bit_counts(hashes), len(hashes))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def _majority(counts: np.ndarray, total: int) -> int:
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist()) if total else 0


def _runs(body: bytes, width: int) -> Iterator[list[bytes]]:
    """The words in runs of about ``PIECE`` bytes, each after the first led by the last ``width - 1`` words before it."""
    if len(body) <= PIECE:
        if words := body.split():
            yield words
        return
    at, lead, some = 0, [], False
    while at < len(body):
        blank = _BLANK.search(body, at + PIECE)
        end = blank.end() if blank else len(body)
        words = lead + body[at:end].split()
        at = end
        if len(words) < width:
            lead = words
            continue
        some = True
        yield words
        lead = words[len(words) - width + 1 :]
    if lead and not some:
        yield lead


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, told: bool = False) -> DataFrame:
    """doc_id, fp (long) of each row; and, if asked for, told: the text's digest."""
    more = ["told"] if told else []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [_signed(fingerprint(t.translate(LOWER), width)) for t in raw_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64()), *[b.column(c) for c in more]], ["doc_id", "fp", *more])

    picked = pick(docs, doc_id=id_col, text=text_col)
    picked = picked.withColumn("told", F.xxhash64("text")) if told else picked
    return picked.mapInArrow(of, "doc_id long, fp long" + (", told long" if told else ""))


def embedded(fp: Column) -> Column:
    """The unary word of the 32 bit counts."""
    low = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def fixed_for(n: int, radius: int = RADIUS) -> int:
    """How many blocks to fix for ``n`` fingerprints: where a fingerprint's rows, and the strangers that it meets in them, are fewest."""
    some = [f for f in range(FIXED, MOST_FIXED + 1) if radius + f <= 32] or [FIXED]
    return min(some, key=lambda f: comb(radius + f, f) * (1 + n * 2 ** (-1.4 * 32 * f / (radius + f))))


def grid_masks(radius: int = RADIUS, fixed: int = FIXED) -> list[int]:
    """For each choice of blocks, the bits of their coordinates. ``radius`` differences leave ``fixed`` of the blocks alike."""
    blocks = max(radius, 0) + fixed
    if blocks > 32:
        raise ValueError(f"radius {radius}: at most {32 - fixed}, as there are 32 coordinates")
    edges = [32 * i // blocks for i in range(blocks + 1)]
    block = [sum(3 << 2 * c for c in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(block[i] for i in chosen)) for chosen in combinations(range(blocks), fixed)]


def _unary(fps: np.ndarray) -> np.ndarray:
    """The unary words of the bit counts, as ``embedded`` has them."""
    low, half = np.uint64(0x5555555555555555), fps >> np.uint64(1)
    return ((fps | half) & low) | ((fps & half & low) << np.uint64(1))


def _near(fps: np.ndarray, unary: np.ndarray, i, j, radius: int) -> np.ndarray:
    """Which of the pairs of places i, j are links: by Manhattan distance first, then by the differing bits."""
    close = np.flatnonzero(np.bitwise_count(unary[i] ^ unary[j]) <= radius)
    return close[np.bitwise_count(fps[i[close]] ^ fps[j[close]]) <= radius]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all of them do, without a cycle."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(*ends.reshape(2, -1).tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            kept.append(k)
    return a[kept], b[kept]


def _flood(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that span a cell, from each member to those that none has reached before, so that a member of a dense cell meets what is left only."""
    left, unary = fps, _unary(fps)
    a, b = [], []
    while len(left) > 1:
        front, left, unary = [(left[0], unary[0])], left[1:], unary[1:]
        while front and len(left):
            x, u = front.pop()
            near = np.flatnonzero(np.bitwise_count(unary ^ u) <= radius)
            if len(near) and len(near := near[np.bitwise_count(left[near] ^ x) <= radius]):
                a.append(np.full(len(near), x))
                b.append(left[near])
                front += zip(left[near], unary[near], strict=True)
                left, unary = np.delete(left, near), np.delete(unary, near)
    return a, b


def _large(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that span a cell. One over ``BLOCK`` members has grids of its own, one block fixed of those that its members differ in, if these halve the pairs at least."""
    if len(fps) > BLOCK:
        unary = _unary(fps)
        differ = int(np.bitwise_or.reduce(unary ^ unary[0]))
        inner, pairs = [], 0
        for part in np.array_split([c for c in range(32) if differ >> 2 * c & 3], max(radius, 0) + 1):
            key = unary & np.uint64(sum(3 << 2 * int(c) for c in part))
            order = np.argsort(key, kind="stable")
            pairs += int((np.unique(key, return_counts=True)[1] ** 2).sum())
            inner.append((key[order], fps[order]))
        if 2 * pairs <= len(fps) ** 2:
            found = [_within(*x, radius) for x in inner]
            return [x for f in found for x in f[0]], [x for f in found for x in f[1]]
    return _flood(fps, radius)


def _within(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that span what is linked in each of the cells, which stand in order: all pairs of small ones at once, large ones one by one."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.concatenate((starts, [len(cell)])))
    a, b = [], []
    few = np.repeat((size > 1) & (size <= SMALL), size)
    own, some = cell[few], fps[few]
    unary, at = _unary(some), np.arange(len(some))
    for k in range(1, SMALL):
        at = at[: np.searchsorted(at, len(own) - k)]
        at = at[own[at] == own[at + k]]
        if not len(at):
            break
        near = at[_near(some, unary, at, at + k, radius)]
        a.append(some[near])
        b.append(some[near + k])
    for s, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        found = _large(fps[s : s + n], radius)
        a += found[0]
        b += found[1]
    return a, b


def _links_of(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is linked in any of the cells, which stand in order."""
    return _spanning(*(np.concatenate(x or [np.empty(0, np.uint64)]) for x in _within(cell, fps, radius)))


def _linked(radius: int):
    """Cells in order, each (cell, fp) together -> links."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(cells: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links_of(np.concatenate(cells), np.concatenate(fps).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        cells: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        for got in batches:
            if not got.num_rows:
                continue
            cell, fp = (got.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp"))
            last = int(np.searchsorted(cell, cell[-1]))
            if last or (cells and cells[-1][-1] != cell[0]):
                yield batch([*cells, cell[:last]], [*fps, fp[:last]])
                cells, fps = [], []
            cells.append(cell[last:])
            fps.append(fp[last:])
        if cells:
            yield batch(cells, fps)

    return of


def links(classes: DataFrame, radius: int = RADIUS, fixed: int | None = None) -> DataFrame:
    """(a, b): links between different fingerprints of ``classes`` (fp, each once) that connect all within ``radius``."""
    word = F.col("u")
    fixed = fixed_for(classes.count(), max(radius, 0)) if fixed is None else fixed
    cells = F.explode(F.array(*[F.xxhash64(F.lit(k), word.bitwiseAND(F.lit(m))) for k, m in enumerate(grid_masks(radius, fixed))]))
    placed = classes.select("fp", embedded(F.col("fp")).alias("u")).select("fp", cells.alias("cell"))
    n = parts(classes.sparkSession)
    return placed.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_linked(radius), "a long, b long")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (long), component_id, the least id that links lead to."""
    rows = settle(fingerprints(docs, id_col, text_col, width))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes, radius))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(grouped.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: one with its least id. An id on different texts stands for each."""
    safe = by_place(docs)
    at_id, at_text = f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"
    told = F.xxhash64(F.col(at_text)).alias("told")
    rows = settle(fingerprints(docs, id_col, text_col, told=True))
    roots = components(links(rows.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    one = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "told")).alias("one"))
    kept = one.select(*null_safe(F.col("one.doc_id")), F.col("one.told").alias("told"))
    # The number of a repeated row needs the rows dealt just as the join does.
    nth = F.row_number().over(Window.partitionBy("some_id", "no_id", "told").orderBy(row_digest(safe)))
    found = safe.select("*", *null_safe(F.col(at_id)), told).join(kept, ["some_id", "no_id", "told"]).withColumn("nth", nth).where("nth = 1")
    return renamed(found, docs.columns)
