"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds.

Base finders give the spans that are always redacted (addresses of mail and hosts, payment cards that pass
their checksum, telephone numbers with a country code). High-recall generators propose further
spans, which may overlap: mail addresses spelt out, groups of digits, single runs of
digits inside longer chains, identity numbers, account numbers. Boosted trees judge each by its
format and its surroundings; a smoothed isotonic fit on samples not used for the trees turns their
sums into probabilities; each kind has the least threshold at which ``PRECISION`` of ``LEAST`` or more chosen samples
are personal there. A kind that reaches it at no threshold has none and adds nothing.
Of overlapping spans chosen the likelier stays. A base span always stays, so what overlaps one isn't asked about.

The trees are fitted on labelled samples: (text, start, end, kind, label). By default these are made
from formats and carrier phrases by a seeded generator; a caller may give others, a bounded list.
The model is a few hundred numbers and is broadcast. One pass, no shuffle.

Each finder is linear in the text: none looks twice at a run it has passed. Formats that the generators know: a
telephone number has 7 to 15 digits with at most 9 marks between, a card 13 to 19 digits, an identity number 7 to 11 or
three groups, an account number 12 to 35 characters; mail addresses have no bound. Overlaps are found by bisection.

Defined cases: a null text is empty; offsets count code points, end exclusive; rows repeat as they
are; an empty table gives an empty result; further columns are ignored by ``find`` and
kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import Shared, by_place, pick, place, renamed, slices

KINDS = ("email", "ip", "card", "phone", "id", "iban")
PRECISION, LEAST = 0.95, 20
SAMPLES = 8000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY, _DIGIT = re.compile(r"[0-9@]"), re.compile(r"[0-9]")

#: Mail addresses spelt out: the mark, and what follows it.
_AT = re.compile(r" ?[\[(] ?at ?[\])] ?", re.I)
_SPELT = re.compile(r"[A-Za-z0-9-]+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]+)+", re.I)
#: Further proposals: (kind, pattern).
_PROPOSE = (
    ("phone", re.compile(r"(?<![0-9A-Za-z+.,-])(?:00|0|\()[0-9][0-9 ().-]{5,22}[0-9](?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.,-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])")),
    ("id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("id", re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{7,11}(?![0-9A-Za-z.,-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
)
#: Words before a candidate that tell what it is.
_HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact|write to|reach", r"phone|tel\b|tel[.:]|call|mobile|fax|whatsapp", r"card|visa|master|amex|payment|credit|debit", r"ssn|social|passport|licen[cs]e no|national id|tax id|identity|born", r"iban|account|bank|transfer", r"version|release|build|v$|isbn|issn|sku|model|page|chapter", r"order|invoice|ticket|ref|tracking|serial|batch|case", r"price|cost|total|usd|eur|population|[$€£#]\s*$", r"date|since|until|year|on the"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    over, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > over and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            yield s, (over := m.end())
            at = text.find("@", over)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    if not _ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-400:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) <= 40 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    over, m = 0, _AT.search(text)
    while m:
        s = m.start()
        while s > over and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start() and (d := _SPELT.match(text, m.end())):
            yield s, d.end()
        over = m.end()
        m = _AT.search(text, over)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the generators propose; spans may overlap."""
    found = {(s, 0, e) for s, e in _spelt(text)} if "(" in text or "[" in text else set()
    if _DIGIT.search(text):
        found |= {(m.start(), KINDS.index(kind), m.end()) for kind, pattern in _PROPOSE for m in pattern.finditer(text)}
    return sorted(found)


def apart(found: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``found`` that no span of ``others`` overlaps."""
    starts, ends = [], []
    for s, _, e in sorted(others):  # as spans that are apart
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return [c for c in found if bisect_left(starts, c[2]) == bisect_right(ends, c[0])]


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() or c == "_" else 2 if c in "$€£#" else 3 if c in ".,:;!?" else 4


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) > 14 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s) or [""]
    digits = "".join(groups)
    before = text[max(0, start - 32) : start]
    seps = re.findall(r"[^0-9A-Za-z]+", s)
    shape = [len(g) for g in groups]
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        len(digits), len(s), len(groups), max(shape), shape[0], shape[-1], float(bool(digits) and luhn(digits)), float("(" in s), float(s.startswith("0")), len(set(seps)),
        s.count("."), s.count("-"), s.count(" "), len(set(digits)), _side(text[start - 1 : start]), _side(text[end : end + 1]),
        float(kind == 5 and _mod97(s)), float(shape in ([4, 2, 2], [2, 2, 4])), float("at" in s.lower() and not digits[:1] == s[:1]),
        *[float(bool(h.search(before))) for h in _HINTS],
    ]


def made_samples(n: int = SAMPLES, seed: int = 20) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, kind, label): formats in carrier phrases, half of them personal."""
    g = np.random.default_rng(seed)

    def digits(k: int) -> str:
        return "".join(map(str, g.integers(0, 10, k)))

    def checked(k: int) -> str:
        d = digits(k - 1)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def unchecked(k: int) -> str:
        d = digits(k - 1)
        return next(d + c for c in "5037912468" if not luhn(d + c))

    def some(*x: str) -> str:
        return x[int(g.integers(len(x)))]

    def word() -> str:
        return "".join(some(*"bdfgklmnprst") + some(*"aeiou") for _ in range(int(g.integers(1, 4))))

    def iban() -> str:
        body = some("DE", "FR", "ES", "GB") + "00" + digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        flat = f"{body[:2]}{check:02d}{body[4:]}"
        return some(flat, " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)))

    personal = (
        (0, lambda: f"{word()}.{word()} [at] {word()} [dot] {some('com', 'org', 'de')}", ("contact", "mail", "write to", "")),
        (0, lambda: f"{word()}{digits(2)}(at){word()}.{some('net', 'com')}", ("e-mail:", "reach me:", "")),
        (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", ("call", "tel.", "phone:", "")),
        (3, lambda: f"{digits(3)}{(s := some('-', '.', ' '))}{digits(3)}{s}{digits(4)}", ("phone", "mobile", "fax", "call me on")),
        (3, lambda: f"0{digits(3)} {digits(6)}", ("tel:", "phone", "call")),
        (2, lambda: checked(16), ("card", "visa", "payment", "", "and", "")),
        (2, lambda: " ".join(re.findall("....", checked(16))), ("card no", "credit card", "")),
        (4, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ("ssn", "social security", "tax id", "")),
        (4, lambda: digits(9), ("passport", "national id", "identity no")),
        (5, iban, ("iban", "account", "bank transfer to", "")),
    )
    other = (
        (3, lambda: f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)}", ("lottery", "version", "chapter")),
        (3, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", ("isbn", "sku", "order", "model", "serial")),
        (3, lambda: f"0{digits(1)}.{digits(2)}.{g.integers(1900, 2030)}", ("date", "on the", "since", "")),
        (2, lambda: unchecked(16), ("", "", "and", "ticket", "tracking", "batch")),
        (2, lambda: unchecked(int(g.integers(13, 20))), ("", "id", "serial", "ref")),
        (2, lambda: checked(int(g.integers(13, 20))), ("tracking", "order", "serial", "batch", "ref")),
        (2, lambda: " ".join(digits(4) for _ in range(4)), ("page", "version", "table", "")),
        (4, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ("sku", "order", "ticket", "case")),
        (4, lambda: digits(int(g.integers(7, 12))), ("", "", "population", "total", "build", "order", "in")),
        (5, lambda: f"{some('AB', 'XK', 'ID')}{digits(2)}{word()[:4].upper():X<4}{digits(8)}", ("model", "sku", "", "serial")),
        (0, lambda: f"{word()} (at) {word()} . {word()}", ("look", "met", "stay")),
    )
    out = []
    for k in range(n):
        kind, make, hints = (personal if k % 2 else other)[int(g.integers(len(personal if k % 2 else other)))]
        span = make()
        left = " ".join([word(), word(), some(*hints)]).rstrip() + " "
        out.append((left + span + some(" ", ". ", ", ", "") + ("" if g.random() < 0.1 else " " + word()), len(left), len(left) + len(span), kind, k % 2))
    return out


class Model:
    """Trees, calibration and a threshold for each kind that has one."""

    def __init__(self, samples: list[tuple[str, int, int, int, int]] | None = None, precision: float = PRECISION):
        samples = made_samples() if samples is None else samples
        x = np.array([features(t, s, k, e) for t, s, e, k, _ in samples])
        y, kinds = np.array([v[4] for v in samples]), np.array([v[3] for v in samples])
        # By place in blocks of 10: samples may alternate by label.
        fitted = np.arange(len(y)) // 10 % 3 != 0
        self.trees = Boosted().fit(x[fitted], y[fitted])
        z = self.trees.raw(x[~fitted])
        self.calibrated = Isotonic().fit(z, y[~fitted])
        self.thresholds = thresholds(self.calibrated(z), y[~fitted], kinds[~fitted], precision)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, added spans), each (start, number of the kind, end)."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """``spans`` of each text; the trees judge the candidates of all together."""
        base = [base_spans(t) for t in texts]
        new = [apart(proposals(t), b) for t, b in zip(texts, base, strict=True)]
        rows = [features(t, *c) for t, cs in zip(texts, new, strict=True) for c in cs]
        if not rows:
            return [(b, []) for b in base]
        p, at, out = self.calibrated(self.trees.raw(np.array(rows))).tolist(), 0, []
        for b, cs in zip(base, new, strict=True):
            chosen = sorted((-v, c) for v, c in zip(p[at : at + len(cs)], cs, strict=True) if v >= self.thresholds[c[1]])
            at += len(cs)
            kept: list[tuple[int, int, int]] = []
            for _, c in chosen:
                k = bisect_left(kept, c)
                if not (k and kept[k - 1][2] > c[0]) and not (k < len(kept) and kept[k][0] < c[2]):
                    kept.insert(k, c)
            out.append((b, kept))
        return out


def thresholds(p: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float, least: int = LEAST) -> np.ndarray:
    """For each kind the least probability, 1/2 or more, at which that share of the chosen, ``least`` or more of them, is personal; infinite if there is none."""
    out = np.full(len(KINDS), np.inf)
    for k in range(len(KINDS)):
        for t in np.unique(p[(kinds == k) & (p >= 0.5)]).tolist():
            chosen = y[(kinds == k) & (p >= t)]
            if len(chosen) >= least and chosen.mean() >= precision:
                out[k] = t
                break
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    sent = Shared(docs.sparkSession, model or Model())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        for b in slices(batches):
            rows = []
            for base, added in m.spans_of([t or "" for t in b.column("text").to_pylist()]):
                n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted([*base, *added])), len(added)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *names])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with each span of a text replaced by its kind in brackets; of spans that overlap, the first's."""
    safe = by_place(docs)
    at = f"c{place(docs, text_col)}"
    sent = Shared(docs.sparkSession, model or Model())

    def one(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not text:
            return text
        out, upto = [], 0
        for s, k, e in spans:
            if s >= upto:
                out += [text[upto:s], f"[{KINDS[k].upper()}]"]
            upto = max(upto, e)
        return "".join([*out, text[upto:]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        for b in slices(batches):
            i, texts = b.schema.get_field_index(at), b.column(at).to_pylist()
            made = [one(t, sorted([*base, *added])) for t, (base, added) in zip(texts, m.spans_of([t or "" for t in texts]), strict=True)]
            yield b.set_column(i, b.schema.field(i), pa.array(made, b.schema.field(i).type))

    return renamed(safe.mapInArrow(of, safe.schema), docs.columns)
