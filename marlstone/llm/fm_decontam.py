"""Benchmark decontamination with an FM-index of each shard of the training texts.

A shard is a run of documents of one task, up to ``SHARD_WORDS`` words. Its words are
numbered by the benchmark's vocabulary; each run of other words, and each end of a
document, is one symbol 0, which no phrase holds. From the shard's suffix array come its
Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled at every
``SAMPLE``-th place. All phrases are searched backward together; rows of the intervals
found are walked to a sampled position; the occurrences' words are merged into
removal spans for each document.

A phrase is a window of ``WINDOW`` consecutive words of an item, or a shorter item as a whole.
A document longer than a shard is indexed in pieces that overlap by ``WINDOW - 1`` words.

The benchmark is the stated query set. It is read to the driver in passes of at most ``PASS_BYTES`` of text, one at
a time (their sizes are summed first). What is broadcast for a pass is its vocabulary, its words as numbers, and where its windows begin, about
its text in size; windows aren't written out. A shard is indexed once in a pass and searched for ``SEARCH`` windows at a time; each
pass is a step of its own over all documents, and steps join their spans. No shuffle; a lost executor's
tasks are run anew.

Defined cases: a null text has no words; a null item text has no phrases; an item whose id is null
counts for spans but isn't listed; repeated items or rows count as they are; empty
tables give no rows or no spans; further columns are kept by ``decontaminate`` and ignored
by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Shared, by_place, pick, place, raw_texts, renamed, slices

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE = 8
PASS_BYTES = 16 << 20
#: Windows that are searched together.
SEARCH = 1 << 18

#: A-Z to a-z; digits, letters and all bytes from 0x80 stay; the rest parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class Phrases:
    """The windows of a pass of items: vocabulary, the items' words as numbers, where different windows begin, and the items that have each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        known = {i: k for k, i in enumerate(self.ids)}
        words, lengths, owners = [], [], []
        for item, text in items:
            ws = words_of((text or "").encode())
            if ws:
                words.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws), np.int32, len(ws)))
                lengths.append(len(ws))
                owners.append(known.get(item, -1))
        self.words = np.concatenate(words) if words else np.empty(0, np.int32)
        n = np.array(lengths, np.int64)
        first, own = np.cumsum(n) - n, np.array(owners, np.int32)
        #: For each length: where its windows begin, and for each window the range of ``items`` that names the items with it.
        self.sets: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.items, at = [], 0
        for length in np.unique(np.minimum(n, window)).tolist():
            mine = np.flatnonzero(n == length if length < window else n >= window)
            many = n[mine] - length + 1
            starts = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            whose = np.repeat(own[mine], many)
            key = np.zeros(len(starts), np.uint64)
            for k in range(length):
                key = key * np.uint64(0x100000001B3) + self.words[starts + k].astype(np.uint64)
            order = np.lexsort((whose, key))
            starts, whose, key = starts[order], whose[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            for k in range(length):  # keys may collide
                new[1:] |= self.words[starts[1:] + k] != self.words[starts[:-1] + k]
            group = np.cumsum(new) - 1
            told = (whose >= 0) & np.concatenate(([True], (group[1:] != group[:-1]) | (whose[1:] != whose[:-1])))
            ends = np.cumsum(np.bincount(group[told], minlength=int(new.sum())))
            self.sets.append((length, starts[new], np.concatenate(([0], ends)) + at))
            self.items.append(whose[told])
            at += int(told.sum())
        self.items = np.concatenate(self.items) if self.items else np.empty(0, np.int32)

    def windows(self, number: int, upto: int = SEARCH) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first, windows, one a row) of a set, so many at a time."""
        length, starts, _ = self.sets[number]
        for at in range(0, len(starts), upto):
            yield at, self.words[starts[at : at + upto, None] + np.arange(length)]

    def items_of(self, number: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``windows``, numbers of items): the items of each window."""
        bounds = self.sets[number][2]
        n = bounds[windows + 1] - bounds[windows]
        return np.repeat(np.arange(len(windows)), n), self.items[np.repeat(bounds[windows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class FMIndex:
    """An FM-index of an array of symbols from 0 to ``sigma``; inside, they go up by one, and 0 ends the text."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.concatenate([text + 1, np.zeros(1, text.dtype)])
        self.n, self.levels = len(text), (int(sigma) + 1).bit_length()
        suffixes = suffix_array(text, self.levels)
        last = text[suffixes - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.levels))))
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            last = np.concatenate([last[~bit], last[bit]])
        self.base = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))
        self.sampled = suffixes % SAMPLE == 0
        self.order = np.cumsum(self.sampled) - 1
        self.samples = suffixes[self.sampled]

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            before = ones[at]
            at = np.where(symbols >> (self.levels - 1 - k) & 1, zeros + before, at - before)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where rows before ``at`` that follow each symbol end: first row of the symbol + its rank."""
        return self.first[symbols] + self._down(symbols, at) - self.base[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases found, first rows, ends of rows) by backward search; phrases: one a row, equal lengths."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, k].astype(np.int64) + 1
            low, high = self.step(c, low), self.step(c, high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows, by walking back to a sampled one."""
        out, walked, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.order[rows[done]]] + walked
            left, rows = left[~done], rows[~done]
            at, symbols = rows, np.zeros(len(rows), np.int64)
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                before = ones[at]
                bit = ones[at + 1] - before
                at = np.where(bit == 1, zeros + before, at - before)
                symbols = symbols << 1 | bit
            rows = self.first[symbols] + at - self.base[symbols]
            walked += 1
        return out


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix order: by as many symbols as fit a word, then by doubling, among those still tied."""
    n, packed = len(text), max(1, 62 // bits)
    while packed & (packed - 1):
        packed &= packed - 1
    key = np.zeros(n, np.int64)
    wide = np.concatenate([text.astype(np.int64), np.zeros(packed, np.int64)])
    for k in range(packed):
        key = key << bits | wide[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    rank = np.empty(n, np.int64)

    def renumber(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """at: the places (rising) of tied suffixes, new: true where another group begins; gives the places still tied."""
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank[order[at]] = begin
        tied = ~new
        tied[:-1] |= ~new[1:]
        return at[tied]

    tied = renumber(np.arange(n), np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if n else np.empty(0, bool))
    length = packed
    while len(tied):
        members = order[tied]
        group = rank[members]
        later = members + length
        follow = np.where(later < n, rank[np.minimum(later, n - 1)], -1 - (later - n))
        again = np.lexsort((follow, group)) if n >= 1 << 30 else np.argsort(group * (2 * n + 2 * length + 2) + follow)
        order[tied] = members[again]
        g, f = group[again], follow[again]
        tied = renumber(tied, np.concatenate(([True], (g[1:] != g[:-1]) | (f[1:] != f[:-1]))))
        length *= 2
    return order


def search_shard(pieces: list[tuple[int, np.ndarray]], phrases: Phrases) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """pieces: (place of its first word, symbols) -> (set number, length, phrase numbers, places) of all occurrences."""
    symbols = np.concatenate([x for _, s in pieces for x in (s, np.zeros(1, np.int32))])
    places = np.concatenate([x for at, s in pieces for x in (np.arange(at, at + len(s)), [-1])])
    known = symbols > 0
    known[1:] |= symbols[:-1] > 0  # the first of each run of zeros stays
    text, places = symbols[known], places[known]
    if not np.any(text):
        return []
    index = FMIndex(text, len(phrases.vocabulary))
    out = []
    for number, (length, _, _) in enumerate(phrases.sets):
        for first, windows in phrases.windows(number):
            which, low, high = index.search(windows)
            if len(which):
                counts = high - low
                rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                out.append((number, length, np.repeat(which + first, counts), places[index.locate(rows)]))
    return out


def spans_of(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: its number of words, merged spans of words hit (end exclusive), items that occur."""
    get = phrases.vocabulary.get
    lengths, pieces, shards, held = [], [], [], 0
    base = 0
    for raw in texts:
        ws = words_of(raw)
        n = len(ws)
        symbols = np.fromiter(map(get, ws, repeat(0)), np.int32, n)
        for at in range(0, max(n, 1), SHARD_WORDS):
            piece = symbols[at : at + SHARD_WORDS + phrases.window - 1]
            if held and held + len(piece) > SHARD_WORDS + phrases.window:
                shards.append(pieces)
                pieces, held = [], 0
            pieces.append((base + at, piece))
            held += len(piece)
        lengths.append(n)
        base += n
    starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    change = np.zeros(base + 1, np.int32)
    items: list[set[int]] = [set() for _ in texts]
    for shard in [*shards, pieces] if pieces else []:
        for number, length, which, at in search_shard(shard, phrases):
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            docs = np.searchsorted(starts, at, side="right") - 1
            many = len(phrases.sets[number][1])
            docs, which = np.divmod(np.unique(docs * many + which), many)
            at, own = phrases.items_of(number, which)
            for pair in np.unique(docs[at] * len(phrases.ids) + own).tolist() if len(phrases.ids) else []:
                items[pair // len(phrases.ids)].add(phrases.ids[pair % len(phrases.ids)])
    hit = np.cumsum(change) > 0
    out = []
    if not hit.any():
        return [(n, [], []) for n in lengths]
    for k, n in enumerate(lengths):
        mine = hit[starts[k] : starts[k] + n]
        spans: list[tuple[int, int]] = []
        if mine.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        out.append((n, spans, sorted(items[k])))
    return out


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans; spans that touch stay apart words, so are joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _annotate(df: DataFrame, text_at: str, phrases: Shared, keep: list[str], more: bool, item: T.DataType) -> DataFrame:
    """``df``'s columns ``keep``, with n_words, spans and items; ``more``: it has them from an earlier pass already."""
    found_fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(item))]
    found_names = [f.name for f in found_fields]
    item_kind = to_arrow_type(item)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases()
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(item_kind)]

        def out(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = spans_of([t for b in group for t in raw_texts(b.column(text_at))], known)
            at = 0
            for b in group:
                mine = found[at : at + b.num_rows]
                at += b.num_rows
                if more:
                    old = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)
                    mine = [(n, merged(s, [(x["start"], x["end"]) for x in was]), sorted({*i, *ids})) for (n, s, i), (was, ids) in zip(mine, old, strict=True)]
                values = [[n for n, _, _ in mine], [[{"start": a, "end": z} for a, z in s] for _, s, _ in mine], [i for _, _, i in mine]]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], [*keep, *found_names])

        group: list[pa.RecordBatch] = []
        held = 0
        for b in slices(batches, 512):
            group.append(b)
            held += b.column(text_at).nbytes
            if held > 6 * SHARD_WORDS:
                yield from out(group)
                group, held = [], 0
        if group:
            yield from out(group)

    schema = T.StructType([*[df.schema[c] for c in keep], *found_fields])
    return df.mapInArrow(of, schema)


def passes(benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> Iterator[Phrases]:
    """The phrases of the benchmark (item_id, text), in passes of about ``pass_bytes`` of text, one at a time."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // pass_bytes) + 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Phrases([tuple(r) for r in benchmark.where(number == k).select("item_id", "text").collect()], window)


def _found(docs: DataFrame, benchmark: DataFrame, text_at: str, keep: list[str], item_col: str, item_text: str, window: int) -> DataFrame:
    """Each pass keeps the text for the next; the last leaves it out unless it is asked for."""
    items = pick(benchmark, item_id=item_col, text=item_text)
    kind, columns = items.schema["item_id"].dataType, [*keep, *({text_at} - {*keep})]
    for k, phrases in enumerate(passes(items, window)):
        docs = _annotate(docs, text_at, Shared(docs.sparkSession, phrases), columns, k > 0, kind)
    return docs.select(*keep, "n_words", "spans", "items")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans (of words, end exclusive), items (ids, rising)."""
    return _found(pick(docs, doc_id=id_col, text=text_col), benchmark, "text", ["doc_id"], item_col, item_text, window)


def items_digest(items: F.Column) -> F.Column:
    """SHA-256, in hex, of the ids as strings in order, joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "drop", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, without contamination: ``drop`` leaves out documents with a hit, ``cut`` cuts the spans from their texts."""
    safe = by_place(docs)
    text_at = f"c{place(docs, text_col)}"
    found = _found(safe, benchmark, text_at, list(safe.columns), item_col, item_text, window)
    if mode == "drop":
        found = found.where(F.size("spans") == 0)
    else:
        schema = found.schema

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                texts = [t if not s else cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(b.column(text_at).to_pylist(), b.column("spans").to_pylist(), strict=True)]
                yield b.set_column(b.schema.get_field_index(text_at), text_at, pa.array(texts, b.schema.field(text_at).type))

        found = found.mapInArrow(of, schema)
    return renamed(found, docs.columns)
