"""Quality by attention-based multiple-instance learning over passages.

A document is the bag of its passages: pieces of ``PASSAGE`` bytes of its text, the whole of
it. Each passage is measured (shares of 24 byte classes, word lengths, repeats of words
at short distances, lines) and encoded by one dense layer. Gated attention,
``a = softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the encodings; a logistic unit
scores their weighted sum. All weights are learnt together from labels of documents by Adam.

Fitting uses a bounded sample of labelled rows (``labelled.PER_CLASS`` of each class, ``labelled.FIT_BYTES`` of text), as
measures that executors make of all passages of each. Scoring is one pass without a shuffle.

Defined cases: a null or empty text is one empty passage; with no labelled sample, or one class
only, all scores are 0.5; null labels are left out; rows repeat as they are; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import Shared, pick, raw_texts, slices

PASSAGE = 400
FOLDS, HELD_OUT = 3, 1
HIDDEN, GATES = 24, 12

#: The class of each byte: blanks, line ends, letters by case, digits, bytes over 0x7F, marks one by one or by kind.
_MARKS = b"*$%#&!|.,;:?-_/\\\"'"
_CLASSES = np.full(256, 23, np.uint8)
_CLASSES[[9, 11, 12, 13, 32]] = 0
_CLASSES[10] = 1
_CLASSES[65:91] = 2
_CLASSES[97:123] = 3
_CLASSES[48:58] = 4
_CLASSES[128:] = 5
for _i, _b in enumerate(_MARKS):
    _CLASSES[_b] = min(6 + _i, 22)
N_CLASSES = 24
MEASURES = N_CLASSES + 6


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(measures of all passages, first passage of each text with the total at the end)."""
    texts = [t or b" " for t in texts]
    counts = np.array([-(-len(t) // PASSAGE) for t in texts])
    first = np.concatenate(([0], np.cumsum(counts)))
    lengths = np.array([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    n = int(first[-1])
    # Where each passage starts in the joined bytes.
    begin = np.repeat(starts - PASSAGE * first[:-1], counts) + PASSAGE * np.arange(n)
    size = np.diff(np.concatenate((begin, [len(b)])))
    passage = np.repeat(np.arange(n, dtype=np.int32), size)
    kinds = _CLASSES[b]
    shares = np.bincount(passage * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / size[:, None]

    inside = kinds > 1
    head, tail = np.zeros(len(b), bool), np.zeros(len(b), bool)
    head[starts], tail[starts + lengths - 1] = True, True  # a word ends with its text
    opens = np.flatnonzero(inside & (head | ~np.concatenate(([False], inside[:-1]))))
    closes = np.flatnonzero(inside & (tail | ~np.concatenate((inside[1:], [False])))) + 1
    own = passage[opens] if len(opens) else np.empty(0, np.int64)
    word = np.fromiter(map(hash, (w for t in texts for w in t.split())), np.int64, len(opens))  # equal words, equal numbers
    words = np.bincount(own, minlength=n)
    least = np.maximum(words, 1)
    more = [words / size * 5, np.bincount(own, weights=np.log1p(closes - opens), minlength=n) / least]
    for lag in (1, 2, 3):
        same = np.zeros(len(word))
        if len(word) > lag:
            same[lag:] = (word[lag:] == word[:-lag]) & (own[lag:] == own[:-lag])
        more.append(np.bincount(own, weights=same, minlength=n) / least)
    more.append(size / PASSAGE)
    return np.column_stack([np.sqrt(shares), *more]).astype(np.float32), first


class Model:
    """The layers; ``score`` gives one number for each bag."""

    NAMES = ("E", "e", "V", "U", "w", "c", "b")

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(MEASURES), np.ones(MEASURES)
        self.E, self.e = g.normal(0, MEASURES**-0.5, (MEASURES, HIDDEN)), np.zeros(HIDDEN)
        self.V, self.U = g.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), g.normal(0, HIDDEN**-0.5, (HIDDEN, GATES))
        self.w, self.c, self.b = g.normal(0, GATES**-0.5, GATES), g.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.E + self.e)
        tv, su = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        s = (tv * su) @ self.w
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        top = np.maximum.reduceat(s, first[:-1])
        a = np.exp(s - top[bag])
        a /= np.add.reduceat(a, first[:-1])[bag]
        m = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(m @ self.c + self.b[0], -30, 30)))
        return x, h, tv, su, a, bag, m, p

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*measures(texts))[-1] if texts else np.empty(0)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        x, h, tv, su, a, bag, m, p = self.forward(x, first)
        d = share * (p - y)
        dm = d[:, None] * self.c
        along = np.einsum("ij,ij->i", dm[bag], h)
        ds = a * (along - np.add.reduceat(a * along, first[:-1])[bag])
        dg = ds[:, None] * self.w
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        dh = (a[:, None] * dm[bag] + dv @ self.V.T + du @ self.U.T) * (1 - h**2)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ ds, "c": m.T @ d, "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], y: np.ndarray, rounds: int = 40, size: int = 64, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """A model of bags of measures; classes weigh the same."""
    model, y = Model(), np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        model.c[:] = 0
        return model
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(0), every.std(0) + 0.05
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g, moved, squared, t = np.random.default_rng(11), {k: 0.0 for k in Model.NAMES}, {k: 0.0 for k in Model.NAMES}, 0
    for epoch in range(rounds):
        order = g.permutation(len(bags))
        for at in range(0, len(order), size):
            some = order[at : at + size]
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])))
            got = model.gradients(np.concatenate([bags[i] for i in some]), first, y[some], weigh[some] / len(some))
            t += 1
            for k, d in got.items():
                d = d + decay * getattr(model, k)
                moved[k], squared[k] = 0.9 * moved[k] + 0.1 * d, 0.999 * squared[k] + 0.001 * d * d
                step = rate * (1 - epoch / rounds) * (moved[k] / (1 - 0.9**t)) / (np.sqrt(squared[k] / (1 - 0.999**t)) + 1e-8)
                setattr(model, k, getattr(model, k) - step)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = labelled.PER_CLASS, fit_bytes: int = labelled.FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    def of(texts: pa.Array) -> list[bytes]:
        x, first = measures(raw_texts(texts))
        return [x[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    made, y = labelled.measured(labelled.sample(docs, labels, label, FOLDS, HELD_OUT, per_class, fit_bytes, id_col, text_col), of, 64)
    return fit([np.frombuffer(m, np.float32).reshape(-1, MEASURES) for m in made], np.array(y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    sent = Shared(docs.sparkSession, model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        for b in slices(batches, 256, 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(m.score(raw_texts(b.column("text"))), pa.float64())], ["doc_id", "score"])

    rows = pick(docs, doc_id=id_col, text=text_col).mapInArrow(of, "doc_id long, score double")
    return rows.select("doc_id", (labelled.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
