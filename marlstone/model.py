"""Schemas and the values that callers hand in: matchers, policies, time bounds."""

from __future__ import annotations

import enum
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from .plans.patterns import java_pattern

#: The label that carries the metric's name.
NAME = "__name__"
LABELS = T.MapType(T.StringType(), T.StringType(), False)
SAMPLES = T.StructType([T.StructField("tsid", T.LongType()), T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])
SERIES = T.StructType([T.StructField("tsid", T.LongType()), T.StructField("key", T.StringType()), T.StructField("labels", LABELS), T.StructField("created_t", T.LongType())])


class MatchOp(enum.Enum):
    EQL = "="
    NEQ = "!="
    LSS = "<"
    GTR = ">"
    LTE = "<="
    GTE = ">="
    EQL_REGEX = "=~"
    NEQ_REGEX = "!~"


_OPPOSITE = {
    MatchOp.EQL: MatchOp.NEQ,
    MatchOp.NEQ: MatchOp.EQL,
    MatchOp.EQL_REGEX: MatchOp.NEQ_REGEX,
    MatchOp.NEQ_REGEX: MatchOp.EQL_REGEX,
    MatchOp.LSS: MatchOp.GTE,
    MatchOp.GTE: MatchOp.LSS,
    MatchOp.GTR: MatchOp.LTE,
    MatchOp.LTE: MatchOp.GTR,
}

@dataclass(frozen=True)
class Matcher:
    """One condition on one label: ``name op value``."""

    op: MatchOp
    name: str
    value: str

    def __post_init__(self) -> None:
        if not isinstance(self.op, MatchOp):
            raise TypeError(f"op is a MatchOp, not {self.op!r}")
        if not isinstance(self.name, str) or not isinstance(self.value, str):
            raise TypeError("label names and values are strings")
        if self.op in (MatchOp.EQL_REGEX, MatchOp.NEQ_REGEX):
            java_pattern(self.value)

    def negate(self) -> Matcher:
        """The opposite test of a label that is present."""
        return replace(self, op=_OPPOSITE[self.op])


def eq(name: str, value: str) -> Matcher:
    return Matcher(MatchOp.EQL, name, value)


def neq(name: str, value: str) -> Matcher:
    return Matcher(MatchOp.NEQ, name, value)


def lt(name: str, value: str) -> Matcher:
    return Matcher(MatchOp.LSS, name, value)


def gt(name: str, value: str) -> Matcher:
    return Matcher(MatchOp.GTR, name, value)


def lte(name: str, value: str) -> Matcher:
    return Matcher(MatchOp.LTE, name, value)


def gte(name: str, value: str) -> Matcher:
    return Matcher(MatchOp.GTE, name, value)


def matches(name: str, pattern: str) -> Matcher:
    return Matcher(MatchOp.EQL_REGEX, name, pattern)


def not_matches(name: str, pattern: str) -> Matcher:
    return Matcher(MatchOp.NEQ_REGEX, name, pattern)


class CheckpointPolicy(enum.Enum):
    """When the store compacts by itself: by the number of new series, never, or as the first and with a line printed before and after."""

    NORMAL = "normal"
    DISABLED = "disabled"
    PRINT = "print"


#: New series after which a commit compacts.
COMPACT_AFTER = 100_000
#: Series of one posting bitmap: what Spark's bitmap functions fix.
BITMAP_BITS = 32_768


def label_set(labels: Mapping[str, str] | Iterable[tuple[str, str]]) -> dict[str, str]:
    """A label set as a dict; a repeated name is refused."""
    pairs = list(labels.items()) if isinstance(labels, Mapping) else list(labels)
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a label name occurs twice")
    if not all(isinstance(x, str) for pair in pairs for x in pair):
        raise TypeError("label names and values are strings")
    return out
