"""Exact dedup with an extendible-hash index on shared files.

1. Each map task folds equal texts that it sees into one row (bytes compared), so
   that a text with a third of all rows reaches its owner as one row a task.
2. The 64-bit key space is cut into ranges, one owner task each. Rows reach their
   owner in the order of their places in its range; the owner chains texts whose keys collide, comparing bytes,
   and enters each text into an extendible hash table: a bucket over its capacity is
   split, and the directory doubles if the bucket was as deep as the directory.
3. Buckets that no later row can enter go to the shared files (Parquet) as the owner passes them; then the directory: for each bucket its
   number, which is the leading bits of the places it holds, and its depth.
4. A lookup goes from a key to its owner, by the owner's depth to a slot of the directory, from there to the bucket, and there to the
   entry of the key's chain with the text's digest. As joins: the directory meets the entries first, since they are
   fewer than documents; an entry that its slot doesn't lead to can't be found.

Nothing is collected; what an owner holds at once is one key's chain, the buckets still open, and a few bytes
for each bucket passed. The number of ranges is the number of shuffle partitions.

Defined cases: a null text counts as empty; a null id loses to every other id; rows
that repeat both id and text are one group, of which one row is kept, the same whenever it is run; an empty table
gives an empty result; further columns are ignored by ``dedup`` and kept by
``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, by_place, null_safe, parts, pick, place, raw_texts, renamed, row_digest, shared_table, slices

#: Entries that a bucket holds before it is split.
BUCKET = 512
#: Bytes of text that a map task holds before it hands on what it has folded.
FOLD_BYTES = 48 << 20

_KEYED = "doc_id long, key long, sha binary"
_FOLDED = "key long, sha binary, body binary, keep_id long, n long"
#: A row is an entry of a bucket, or, where the key is null, a bucket of the directory.
INDEX = "owner int, depth int, bucket long, key long, chain int, sha binary, keep_id long, n long"
#: Leading bits of a key that tell its owner.
LEAD = 20


def _key(body: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(body)
    return h - (1 << 64) if h >> 63 else h


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        bodies = [t.translate(LOWER) for t in raw_texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array([_key(t) for t in bodies], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in bodies], pa.binary())],
            ["doc_id", "key", "sha"],
        )


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of this task as one row: key, digest, text, largest id, number."""

    def out(groups: dict) -> pa.RecordBatch:
        rows = [(_key(body), hashlib.sha256(body).digest(), body, keep, n) for body, (keep, n) in groups.items()]
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "sha", "body", "keep_id", "n"])

    groups: dict[bytes, list] = {}
    held = 0
    for b in slices(batches):
        for i, t in zip(b.column("doc_id").to_pylist(), raw_texts(b.column("text")), strict=True):
            body = t.translate(LOWER)
            if (g := groups.get(body)) is None:
                groups[body] = [i, 1]
                held += len(body) + 200
            else:
                g[0] = larger(g[0], i)
                g[1] += 1
        if held > FOLD_BYTES:
            yield out(groups)
            groups, held = {}, 0
    if groups:
        yield out(groups)


class ExtendibleHash:
    """A hash table whose directory, indexed by the leading bits of a place, doubles as buckets overflow.

    Two entries of one place can't be told apart by any depth, so they share a chain,
    which counts as one entry of its bucket. If places rise, buckets can be retired once passed.
    """

    def __init__(self, capacity: int = BUCKET):
        self.capacity, self.depth, self.retired = capacity, 0, 0
        self.directory: list[list] = [[0, {}]]  # each: [depth of the bucket, {place: chain}]

    @staticmethod
    def _slot(place: int, depth: int) -> int:
        return place >> (64 - depth) if depth else 0

    def chain(self, place: int) -> list:
        """The chain of ``place``, for reading and appending; its bucket is split if it is over its capacity."""
        while True:
            bucket = self.directory[self._slot(place, self.depth)]
            if place in bucket[1]:
                return bucket[1][place]
            if len(bucket[1]) < self.capacity or bucket[0] == 63:
                return bucket[1].setdefault(place, [])
            if bucket[0] == self.depth:
                self.directory = [b for b in self.directory for _ in (0, 1)]
                self.depth += 1
                self.retired *= 2
            low, high = [bucket[0] + 1, {}], [bucket[0] + 1, {}]
            for k, chain in bucket[1].items():
                (high if self._slot(k, bucket[0] + 1) & 1 else low)[1][k] = chain
            width = 1 << (self.depth - bucket[0])
            at = self._slot(place, self.depth) // width * width
            self.directory[at : at + width] = [low] * (width // 2) + [high] * (width // 2)

    def retire(self, place: int = 1 << 64) -> Iterator[tuple[int, int, dict]]:
        """(number, depth, entries) of each bucket that lies before ``place``; its entries are then forgotten."""
        upto = self._slot(place, self.depth) if place < 1 << 64 else 1 << self.depth
        while self.retired < upto:
            bucket = self.directory[self.retired]
            width = 1 << (self.depth - bucket[0])
            if self.retired + width > upto:
                break
            entries, bucket[1] = bucket[1], {}
            yield self.retired // width, bucket[0], entries
            self.retired += width

    def buckets(self) -> Iterator[tuple[int, int, dict]]:
        """(number of the bucket at its own depth, depth, entries) of each bucket."""
        at = 0
        while at < len(self.directory):
            depth, entries = self.directory[at]
            width = 1 << (self.depth - depth)
            yield at // width, depth, entries
            at += width


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One owner's range, in the order of places: chains by comparing bytes, the buckets as they are passed, then the directory."""
    table: ExtendibleHash | None = None
    owner, last, bodies, since = 0, None, [], 0
    rows: list[tuple] = []

    def enter(number: int, depth: int, entries: dict) -> None:
        for chain in entries.values():
            rows.extend((owner, depth, number, key, at, *entry) for at, (key, *entry) in enumerate(chain))

    for b in slices(batches, 256):
        for own, at, key, sha, body, keep, n in zip(*(b.column(c).to_pylist() for c in ("owner", "place", "key", "sha", "body", "keep_id", "n")), strict=True):
            if table is None:
                owner, table = own, ExtendibleHash()
            at &= (1 << 64) - 1
            if at != last:
                last, bodies, since = at, [], since + 1
                if since > BUCKET:
                    since = 0
                    for passed in table.retire(at):
                        enter(*passed)
            chain = table.chain(at)
            for k, known in enumerate(bodies):
                if known == body:
                    chain[k][2:] = [larger(chain[k][2], keep), chain[k][3] + n]
                    break
            else:
                bodies.append(body)
                chain.append([key, sha, keep, n])
        if len(rows) > 20_000:
            yield _index_batch(rows)
            rows.clear()
    if table is None:
        return
    for passed in table.retire():
        enter(*passed)
        if len(rows) > 20_000:
            yield _index_batch(rows)
            rows.clear()
    for number, depth, _ in table.buckets():
        rows.append((owner, depth, number, None, None, None, None, None))
    for at in range(0, len(rows), 20_000):
        yield _index_batch(rows[at : at + 20_000])


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    names = ["owner", "depth", "bucket", "key", "chain", "sha", "keep_id", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _located(df: DataFrame, owners: int) -> DataFrame:
    """``df`` with the owner of its key, and the key's place in the owner's range: 64 bits that rise with the key."""
    lead = F.shiftrightunsigned("key", 64 - LEAD) * owners
    at = F.shiftleft(F.pmod(lead, F.lit(1 << LEAD)), 64 - LEAD).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 64 - LEAD) - 1)))
    return df.withColumn("owner", F.floor(lead / (1 << LEAD)).cast("int")).withColumn("place", at)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: a row for each different text, by bucket, and for each bucket; on shared files. Columns: ``INDEX``."""
    owners = min(parts(docs.sparkSession), 1 << LEAD)
    folded = pick(docs, doc_id=id_col, text=text_col).mapInArrow(_fold, _FOLDED)
    # Places as unsigned numbers.
    dealt = _located(folded, owners).repartitionById(owners, F.col("owner")).sortWithinPartitions(F.col("place").bitwiseXOR(F.lit(-(1 << 63))))
    return shared_table(dealt.mapInArrow(_own, INDEX), "exthash")


def found(index: DataFrame) -> DataFrame:
    """key, sha, keep_id, n: what lookups through the directory find."""
    owners = min(parts(index.sparkSession), 1 << LEAD)
    directory = index.where("key is null").select("owner", "depth", "bucket")
    depths = directory.groupBy("owner").agg(F.max("depth").alias("whole"))  # a row for each owner
    wide = F.expr("shiftleft(1L, whole - depth)")
    slots = directory.join(F.broadcast(depths), "owner").select("owner", "depth", "bucket", F.explode(F.sequence(F.col("bucket") * wide, (F.col("bucket") + 1) * wide - 1)).alias("slot"))
    entries = _located(index.where("key is not null").select("key", "sha", "keep_id", "n", F.col("depth").alias("own_depth"), F.col("bucket").alias("own_bucket")), owners)
    slot = F.when(F.col("whole") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(place, 64 - whole)"))
    reached = entries.join(F.broadcast(depths), "owner").withColumn("slot", slot).join(slots, ["owner", "slot"])
    return reached.where("own_depth = depth and own_bucket = bucket").select("key", "sha", "keep_id", "n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z. The row with the
    largest id of a group is kept.
    """
    index = found(build_index(docs, id_col, text_col)).withColumnRenamed("n", "group_size")
    rows = pick(docs, doc_id=id_col, text=text_col).mapInArrow(_keyed, _KEYED)
    # Only repeated rows (same id, same text) give a number over 1. This stands before the join, which Spark may then split by skew.
    nth = F.row_number().over(Window.partitionBy("key", "sha", "doc_id").orderBy("key"))
    met = rows.withColumn("nth", nth).join(index, ["key", "sha"])
    return met.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts: that with the largest id.

    Rows meet their index entry by digest and id together, so that a large group is
    dealt over all tasks.
    """
    safe = by_place(docs)
    at_id, at_text = f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shas = [hashlib.sha256(t.translate(LOWER)).digest() for t in raw_texts(b.column(at_text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shas, pa.binary())], [*b.schema.names, "mine"])

    schema = T.StructType([*safe.schema.fields, T.StructField("mine", T.BinaryType())])
    index = found(build_index(docs, id_col, text_col)).select(F.col("sha").alias("mine"), *null_safe(F.col("keep_id")))
    rows = safe.mapInArrow(digested, schema).select("*", *null_safe(F.col(at_id)))
    # The number of a repeated row needs the rows dealt just as the join does.
    nth = F.row_number().over(Window.partitionBy("mine", "some_id", "no_id").orderBy(row_digest(safe)))
    met = rows.join(index, ["mine", "some_id", "no_id"]).withColumn("nth", nth).where("nth = 1")
    return renamed(met, docs.columns)
