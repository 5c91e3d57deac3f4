"""Token counts of a byte-pair model at every prefix of a text, by dynamic programming.

For each prefix the last token of its encoding is kept, and the number of tokens. The encoding
of a prefix that ends with token ``t`` is that of the prefix before ``t``, and ``t``, where the two
last tokens stand next to each other when encoded alone ("a valid pair"); just one token fulfils
that at each place. Pairs are judged once by the tokenizer library itself and kept.

No token spans a word's end and the blank after it, nor a character outside the vocabulary, so texts are
cut there into segments; the programme runs over all new segments of a batch at once, place by place,
as array operations. Counts at segment ends, summed up, and counts inside one segment give
the count at any prefix: truncation and budgets need no second encoding.

The vocabulary file is read on the driver (its size is checked against ``MODEL_BYTES``) and broadcast.
One pass over the documents, no shuffle.

Defined cases: a null or empty text has no bytes and no tokens; strings of special tokens are ordinary text;
rows repeat as they are; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import pick, slices, worker_state

MODEL_BYTES = 16 << 20
LIMIT = 4096
#: Bytes of segments whose counts a worker keeps, a fixed cost for each among them; then it starts anew. Longer ones than ``LONG`` aren't kept.
KEPT, EACH = 96 << 20, 160
#: Longer segments go through the programme one at a time.
LONG = 96
BLANK = "▁"
_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """64-bit keys to small numbers, open addressing, whole arrays at a time."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -2 where there is none."""
        out = np.full(len(keys), -2, np.int32)
        at = self._home(keys)
        here = self.keys[at]
        hit = here == keys
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero(~hit & (here != -1))
        while len(left):
            at[left] = (at[left] + 1) & (1 << self.bits) - 1
            here = self.keys[at[left]]
            hit = here == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (here != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enters new keys, each once; starts anew when more than half full."""
        if self.n + len(keys) > 1 << (self.bits - 1):
            self.__init__(self.bits)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (1 << self.bits) - 1
        self.n += len(keys)


class PrefixCounter:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        pieces = [(p.piece, i) for i, p in enumerate(proto.pieces) if p.type == 1]
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix or any(BLANK in p.lstrip(BLANK) for p, _ in pieces):
            raise ValueError("texts can't be cut before blanks under this model")
        self.piece = dict(pieces)
        self.name = {i: p for p, i in pieces}
        self.longest = max(len(p) for p in self.piece)
        self.size = len(proto.pieces) + 2
        self.start, self.other = self.size - 2, self.size - 1  # stand for no token, and for a character outside the vocabulary
        proto.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.trie = Table(18)
        known: dict[int, int] = {}
        for p, i in pieces:
            h = 0
            for k, c in enumerate(p):
                h = self._roll(h, ord(c))
                known[h] = i if k == len(p) - 1 else known.get(h, -1)
        self.trie.put(np.array(list(known), np.uint64).view(np.int64), np.array(list(known.values()), np.int32))
        self.pairs = Table(21)
        self.kept: dict[str, int] = {}
        self.kept_bytes = 0

    @staticmethod
    def _roll(h: int, c: int) -> int:
        return (h * 0x100000001B3 + c + 1) & (1 << 64) - 1

    def valid(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs (earlier * size + later) stand next to each other."""
        got = self.pairs.get(keys)
        new = np.unique(keys[got == -2])
        if len(new):
            a, b = new // self.size, new % self.size
            texts = [self.name.get(x, "") + self.name[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            want = [([x] if x in self.name else []) + [y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            verdict = np.array([int(g == w) for g, w in zip(self.bare.encode(texts, num_threads=1), want, strict=True)], np.int32)
            self.pairs.put(new, verdict)
            got[got == -2] = verdict[np.searchsorted(new, keys[got == -2])]
        return got == 1

    def _programme(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts at all places of all segments, first place of each); a segment has a place before each character and one at its end."""
        n = np.array([len(s) for s in segments])
        base = np.concatenate(([0], np.cumsum(n + 1)))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars = np.arange(len(codes)) + np.repeat(np.arange(len(segments)), n)  # the place before each character
        ends = np.repeat(base[1:] - 1, n)
        value = np.zeros(base[-1], np.uint64)
        value[chars] = codes
        begin, last_place, h = chars, ends, np.zeros(len(chars), np.uint64)
        starts, tokens, lengths = [], [], []
        for k in range(1, self.longest + 1):
            h = h * np.uint64(0x100000001B3) + value[begin + k - 1] + np.uint64(1)
            got = self.trie.get(h.view(np.int64))
            if k == 1:
                alone = begin[got < 0]
                starts.append(alone)
                tokens.append(np.full(len(alone), self.other, np.int32))
                lengths.append(np.ones(len(alone), np.int16))
            whole = got >= 0
            starts.append(begin[whole])
            tokens.append(got[whole])
            lengths.append(np.full(int(whole.sum()), k, np.int16))
            on = (got > -2) & (begin + k < last_place)
            begin, last_place, h = begin[on], last_place[on], h[on]
            if not len(begin):
                break
        start, token = np.concatenate(starts), np.concatenate(tokens)
        end = start + np.concatenate(lengths)
        local = end - np.repeat(base[:-1], n + 1)[start]
        order = np.argsort(local.astype(np.int16), kind="stable")
        start, token, end = start[order], token[order].astype(np.int64), end[order]
        cut = np.searchsorted(local[order], np.arange(1, int(n.max(initial=0)) + 2))
        last = np.full(base[-1], self.start, np.int64)
        count = np.zeros(base[-1], np.int32)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at, t, to = start[s:e], token[s:e], end[s:e]
            before = last[at]
            alone = t == self.other
            key = np.where(before == self.other, self.start, before) * self.size + t
            ok = alone.copy()
            ok[~alone] = self.valid(key[~alone])
            at, t, to, alone = at[ok], t[ok], to[ok], alone[ok]
            last[to] = t
            cost = np.ones(len(t), np.int32)
            if alone.any():
                c = value[at[alone]]
                cost[alone] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            count[to] = count[at] + cost
        return count, base

    def inside(self, segment: str) -> list[int]:
        """The counts at all places of one segment, for long ones too."""
        last, count = [self.start], [0]
        memo: dict[int, bool] = {}
        for i in range(1, len(segment) + 1):
            for k in range(1, min(i, self.longest) + 1):
                t = self.piece.get(segment[i - k : i])
                if t is None:
                    continue
                before = last[i - k]
                key = (self.start if before == self.other else before) * self.size + t
                if key not in memo:
                    memo[key] = bool(self.valid(np.array([key]))[0])
                if memo[key]:
                    last.append(t)
                    count.append(count[i - k] + 1)
                    break
            else:
                last.append(self.other)
                count.append(count[i - 1] + len(segment[i - 1].encode("utf-8", "surrogatepass")))
        return count

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def ends(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """For each text its segments and the counts at their ends."""
        cut = [self.segments(t) for t in texts]
        if self.kept_bytes > KEPT:
            self.kept, self.kept_bytes = {}, 0
        kept = self.kept
        new = [s for s in {s for segments in cut for s in segments} if s not in kept]
        short = sorted((s for s in new if len(s) <= LONG), key=len)
        for at in range(0, len(short), 50_000):
            some = short[at : at + 50_000]
            count, base = self._programme(some)
            kept.update(zip(some, count[base[1:] - 1].tolist(), strict=True))
            self.kept_bytes += sum(map(len, some)) + EACH * len(some)
        long = {s: self.inside(s)[-1] for s in new if len(s) > LONG}
        of = lambda s: kept[s] if len(s) <= LONG else long[s]
        return [(segments, np.cumsum(np.fromiter(map(of, segments) if long else map(kept.__getitem__, segments), np.int64, len(segments)))) for segments in cut]

    def prefix_counts(self, text: str) -> np.ndarray:
        """The number of tokens of ``text[:i]`` for each i from 0 to its length."""
        out, total = [np.zeros(1, np.int64)], 0
        for k, s in enumerate(self.segments(text)):
            inner = np.array(self.inside(s), np.int64) + total
            out.append(inner[1 + (k == 0) :])  # the first blank isn't of the text
            total = int(inner[-1])
        return np.concatenate(out)

    def longest_within(self, segments: list[str], ends: np.ndarray, limit: int) -> int:
        """The length of the longest prefix with at most ``limit`` tokens."""
        k = int(np.searchsorted(ends, limit, side="right"))
        length = sum(map(len, segments[:k])) - (k > 0)
        if k < len(segments):
            before = int(ends[k - 1]) if k else 0
            inner = [i for i, c in enumerate(self.inside(segments[k])) if before + c <= limit]
            length += max(inner) - (k == 0 and max(inner) > 0)
        return length


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is over {MODEL_BYTES} bytes")
    return data


def counts(docs: DataFrame, model_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix within ``limit``."""
    sent = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        counter = worker_state("token_prefix", hash(model), lambda: PrefixCounter(model))
        for b in slices(batches, 512):
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = []
            for t, (segments, ends) in zip(texts, counter.ends(texts), strict=True):
                total = int(ends[-1]) if len(ends) else 0
                fit = len(t) if total <= limit else counter.longest_within(segments, ends, limit)
                rows.append((len(t.encode()), total, total > limit, fit))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(of, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and tokens: the number of tokens of every prefix, from the empty one to the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        counter = worker_state("token_prefix", hash(model), lambda: PrefixCounter(model))
        for b in slices(batches, 64):
            tokens = [counter.prefix_counts(t or "").astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(of, "doc_id long, tokens array<int>")
