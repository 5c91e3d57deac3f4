"""Compiles matchers to one boolean column, with the meaning of an absent label written out.

``v`` is the value of a matcher's label, null if the label is absent; ``x`` the matcher's value.

========== =============================== ==================
op         meaning                         absent label
========== =============================== ==================
=          v = x                           fails
!=         v is distinct from x            passes (see below)
< > <= >=  byte order                      fails
=~         x matches the whole of v        fails
!~         x doesn't match the whole of v  fails
========== =============================== ==================

If every matcher is ``!=``, each asks for the label to be present. ``neq_absent="reject"`` asks for it
always. Matchers are joined by AND in any order; none at all match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Matcher, MatchOp
from .patterns import java_pattern


def whole(pattern: str) -> str:
    """The pattern anchored at both ends; ``$`` would also match before a last line end."""
    return rf"\A(?:{java_pattern(pattern)})\z"


#: The order of label values: that of their bytes, which is Spark's for strings. Numbers compare as text.
_TESTS: dict[MatchOp, Callable[[Column, str], Column]] = {
    MatchOp.EQL: lambda v, x: v == x,
    MatchOp.NEQ: lambda v, x: v != x,
    MatchOp.LSS: lambda v, x: v < x,
    MatchOp.GTR: lambda v, x: v > x,
    MatchOp.LTE: lambda v, x: v <= x,
    MatchOp.GTE: lambda v, x: v >= x,
    MatchOp.EQL_REGEX: lambda v, x: v.rlike(whole(x)),
    MatchOp.NEQ_REGEX: lambda v, x: ~v.rlike(whole(x)),
}


def value_test(m: Matcher, v: Column) -> Column:
    """The test of a value that is present."""
    return _TESTS[m.op](v, m.value)


def absent_passes(m: Matcher, matchers: Sequence[Matcher], neq_absent: str = "pass") -> bool:
    """Whether a series without the label passes matcher ``m`` of ``matchers``."""
    if neq_absent not in ("pass", "reject"):
        raise ValueError(f"neq_absent is 'pass' or 'reject', not {neq_absent!r}")
    return m.op is MatchOp.NEQ and neq_absent == "pass" and any(o.op is not MatchOp.NEQ for o in matchers)


def compile_matchers(matchers: Sequence[Matcher], label: Callable[[str], Column], neq_absent: str = "pass") -> Column:
    """The condition on a row whose labels ``label`` gives by name. Never null."""
    if not matchers:
        return F.lit(False)

    def one(m: Matcher) -> Column:
        v = label(m.name)
        if absent_passes(m, matchers, neq_absent):
            return ~v.eqNullSafe(F.lit(m.value))
        return v.isNotNull() & value_test(m, v)

    return reduce(lambda a, b: a & b, map(one, matchers))
