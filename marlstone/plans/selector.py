"""A selector in text: ``metric{label="value", other=~"pattern"}``. An addition of this engine's own."""

from __future__ import annotations

import re

from ..model import NAME, Matcher, MatchOp

_METRIC = re.compile(r"\s*([A-Za-z_:][A-Za-z0-9_:]*)?\s*(\{)?")
_ITEM = re.compile(r"""\s*([A-Za-z_][A-Za-z0-9_]*)\s*(=~|!~|!=|<=|>=|=|<|>)\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')\s*""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1] if m[1] in "\"'\\" else "\\" + m[1]), quoted[1:-1], flags=re.S)


def parse_selector(text: str) -> list[Matcher]:
    """The matchers of a selector; a ValueError names the place of a mistake."""
    head = _METRIC.match(text)
    out = [Matcher(MatchOp.EQL, NAME, head[1])] if head[1] else []
    at = head.end()
    if head[2]:
        while not re.compile(r"\s*\}").match(text, at):
            item = _ITEM.match(text, at)
            if not item:
                raise ValueError(f"no matcher at {at} in {text!r}")
            out.append(Matcher(MatchOp(item[2]), item[1], _text(item[3])))
            at = item.end()
            if text[at : at + 1] == ",":
                at += 1
            elif text[at : at + 1] != "}":
                raise ValueError(f"no comma or brace at {at} in {text!r}")
        at = re.compile(r"\s*\}").match(text, at).end()
    if text[at:].strip() or not (head[1] or head[2]):
        raise ValueError(f"no selector at {at} in {text!r}")
    return out
