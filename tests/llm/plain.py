"""Plain versions of the operators' contracts, a row at a time, to hold the operators against."""

from __future__ import annotations

import re

import xxhash


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def fingerprint(t: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows: list[tuple[int, int]], radius: int = 3) -> dict[int, int]:
    """(id, fingerprint) -> id: component's least id."""
    by_fp: dict[int, list[int]] = {}
    for i, fp in rows:
        by_fp.setdefault(fp, []).append(i)
    left, out = set(by_fp), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        ids = [i for x in group for i in by_fp[x]]
        out |= dict.fromkeys(ids, min(ids))
    return out


def luhn(d: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def private(t: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base finders."""
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def secrets(t: str | None) -> list[tuple[int, int, int]]:
    t = t or ""
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def windows(items: list[tuple[int | None, str | None]]) -> dict[tuple[str, ...], set]:
    out: dict[tuple[str, ...], set] = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - 9) if ws else 0):
            out.setdefault(tuple(ws[i : i + 10]), set()).add(item)
    return out


def contamination(t: str | None, items: list[tuple[int | None, str | None]]) -> tuple[int, int, list[int]]:
    """(words, words hit, items that occur)."""
    w, hit, found, wins = words(t), set(), set(), windows(items)
    for n in {len(x) for x in wins}:
        for j in range(len(w) - n + 1):
            if (of := wins.get(tuple(w[j : j + n]))) is not None:
                hit.update(range(j, j + n))
                found |= of
    return len(w), len(hit), sorted(found - {None})


def equal_texts(rows: list[tuple[int | None, str | None]]) -> dict[str, tuple[int | None, int]]:
    """normalised text -> (id that stays, number of rows)."""
    out: dict[str, list] = {}
    for i, t in rows:
        out.setdefault(lower(t), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in out.items()}


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """By resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and out[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over
