"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its n-grams of 3 to 6 characters (code points; A-Z lower-cased, white space as
one blank), hashed to 2^20 places. Each place is scaled by
``r = ln((p / |p|) / (q / |q|))``, ``p`` and ``q`` the smoothed numbers of toxic and other
sample texts that have it; a logistic regression with an L1 penalty is fitted on the scaled set by
accelerated proximal steps. All places of the sample take part. The penalty leaves weight on few, so that the length
of a text, all of which is read, doesn't move its score by itself.

Fitting uses a bounded sample of labelled rows: at most ``PER_CLASS`` of each class and ``FIT_BYTES`` of
text, as sets of numbers that executors make. Scoring is one pass without a shuffle.

Defined cases: a null text is empty; a text without n-grams gets the intercept's score; with no
labelled sample, or one class only, all scores are 0.1; null labels are left out;
rows repeat as they are; an empty table gives an empty result; further columns are kept by
``reject`` and ignored by ``score``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled
from .common import LOWER, Shared, by_place, pick, place, raw_texts, renamed, slices

LOW, HIGH, BITS = 3, 6, 20
#: Characters of a text that are looked at together.
PIECE = 1 << 19
FOLDS, HELD_OUT = 5, 0
#: Labelled rows of each class, and bytes of their texts, that the fit takes at most: sets of 16 bytes for each byte of text at most.
PER_CLASS, FIT_BYTES = 1000, 8 << 20
#: Texts that the fit multiplies together.
BLOCK = 64


def grams(raw: bytes) -> np.ndarray:
    """The places of a text's n-grams, each once. Longer texts go in pieces that overlap by an n-gram less one character."""
    body = b" " + b" ".join(raw.translate(LOWER).split()) + b" "
    codes = np.frombuffer(body, np.uint8) if body.isascii() else np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    pieces = [_grams(codes[at : at + PIECE + HIGH - 1]) for at in range(0, max(len(codes) - HIGH + 1, 1), PIECE)]
    return pieces[0] if len(pieces) == 1 else once(np.concatenate(pieces))


def _grams(codes: np.ndarray) -> np.ndarray:
    if len(codes) < LOW:
        return np.empty(0, np.int64)
    c = codes.astype(np.uint64) + np.uint64(1)
    value, out = c, []
    for n in range(2, HIGH + 1):
        if len(c) < n:
            break
        value = value[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n >= LOW:
            out.append(((value ^ value >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32))
    return once(np.concatenate(out).astype(np.int64))


def once(places: np.ndarray, seen: list = []) -> np.ndarray:  # noqa: B006  the scratch array is kept on purpose
    """``places`` without repeats, in no order."""
    if not seen:
        seen.append(np.empty(1 << BITS, np.int32))
    at = np.arange(len(places), dtype=np.int32)
    seen[0][places] = at
    return places[seen[0][places] == at]


def packed(places: np.ndarray) -> bytes:
    """A set of places as few bytes: what reaches the driver is held there by the JVM and by Python."""
    gaps = np.diff(np.sort(places), prepend=0).astype("<i4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(made: bytes) -> np.ndarray:
    """The places, in order."""
    gaps = np.frombuffer(zlib.decompress(made), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<i4").ravel(), dtype=np.int32)


class Model:
    """Weights by place and an intercept; the score is the logistic of their sum."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def score(self, raw: bytes) -> float:
        z = float(self.weights[grams(raw)].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def ratios(sets: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(r of each place, how many texts have it)."""
    p, q = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for places, label in zip(sets, y.tolist(), strict=True):
        (p if label else q)[places] += 1  # each place is in a set once
    return np.log(((p + alpha) / (y.sum() + 2 * alpha)) / ((q + alpha) / ((1 - y).sum() + 2 * alpha))), p + q


def fit(sets: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, penalty: float = 5e-4, rounds: int = 80) -> Model:
    """A model of n-gram sets, which are used up; classes weigh the same.

    Places that only one text has, and the same one, have equal ratios and equal steps, so that their weights
    stay equal: they are fitted as one weight with their number. Products go through blocks of texts.
    """
    y = np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.log(0.1 / 0.9))
    r, n = ratios(sets, y, alpha)
    shared = np.flatnonzero(n > 1)
    number = np.full(1 << BITS, -1, np.int32)
    number[shared] = np.arange(len(shared), dtype=np.int32)
    single, many, blocks, held = [], np.zeros(len(sets)), [], []
    # The shared places, then each text's own.
    scale = np.concatenate([r[shared], np.zeros(len(sets))])
    sets.reverse()
    for k in range(len(y)):
        places = sets.pop()
        mine = places[n[places] == 1]
        single.append(mine)
        many[k] = len(mine)
        if len(mine):
            scale[len(shared) + k] = r[mine[0]]
        cols = number[places]
        held.append(cols[cols >= 0])
        if len(held) == BLOCK or k == len(y) - 1:
            lengths = np.array([len(c) for c in held])
            some = np.flatnonzero(lengths)
            blocks.append((k + 1 - len(held) + some, lengths[some], np.concatenate(held)))
            held = []
    weigh = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def times(w: np.ndarray) -> np.ndarray:
        scaled = w * scale
        out = scaled[len(shared) :] * many
        for rows, lengths, cols in blocks:
            if len(rows):
                out[rows] += np.add.reduceat(scaled[cols], np.cumsum(lengths) - lengths)
        return out

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shared))
        for rows, lengths, cols in blocks:
            out += np.bincount(cols, np.repeat(g[rows], lengths), len(shared))
        return np.concatenate([out, g]) * scale

    w, b = np.zeros(len(scale)), 0.0
    count = np.concatenate([np.ones(len(shared)), many])
    norm = lambda v: max(float(np.sqrt((count * v * v).sum())), 1e-12)
    v = back(np.ones(len(y)) / len(y))
    for _ in range(12):  # the largest curvature, by the power method
        v = back(weigh * times(v / norm(v)))
    rate = 1 / max(0.25 * norm(v) * 1.5, 1e-9)
    last, look, t = w, w, 1.0
    for _ in range(rounds):
        z = times(look) + b
        g = weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        step = look - rate * back(g)
        w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        b -= 2.0 * g.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, last, t = w + (t - 1) / t_next * (w - last), w, t_next
    weights = np.zeros(1 << BITS)
    weights[shared] = (w * scale)[: len(shared)]
    for k, mine in enumerate(single):
        weights[mine] = (w * scale)[len(shared) + k]
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = labelled.sample(docs, labels, label, FOLDS, HELD_OUT, per_class, fit_bytes, id_col, text_col)
    made, y = labelled.measured(rows, lambda texts: [packed(grams(t)) for t in raw_texts(texts)])
    made.reverse()
    return fit([unpacked(made.pop()) for _ in y], np.array(y))


def _scored(df: DataFrame, model: Model, text_at: str, keep: list[str]) -> DataFrame:
    sent = Shared(df.sparkSession, model)  # 4 MB, whatever the input

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        for b in slices(batches):
            scores = [m.score(t) for t in raw_texts(b.column(text_at))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(scores, pa.float64())], [*keep, "score"])

    return df.mapInArrow(of, T.StructType([*[df.schema[c] for c in keep], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    rows = _scored(pick(docs, doc_id=id_col, text=text_col), model, "text", ["doc_id"])
    return rows.select("doc_id", (labelled.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more."""
    safe = by_place(docs)
    rows = _scored(safe, model, f"c{place(docs, text_col)}", list(safe.columns)).where(F.col("score") < threshold)
    return renamed(rows, docs.columns)
