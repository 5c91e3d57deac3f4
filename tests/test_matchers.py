"""The truth table of the matchers, and the three ways to resolve them."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.model import Matcher, MatchOp, eq, label_set, matches, neq
from marlstone.operators.resolve import STRATEGIES, resolve
from marlstone.plans.selector import parse_selector

VALUES = [None, "", "a", "ab", "abcdefA", "abcdefB", "b\n", "é", "10", "5"]


def passes(ms, labels, reject=False):
    """A plain reading of the rules."""
    if not ms:
        return False
    lax = not reject and any(m.op is not MatchOp.NEQ for m in ms)
    for m in ms:
        v, x = labels.get(m.name), m.value
        if v is None:
            if m.op is MatchOp.NEQ and lax:
                continue
            return False
        b, c = v.encode(), x.encode()
        ok = {MatchOp.EQL: v == x, MatchOp.NEQ: v != x, MatchOp.LSS: b < c, MatchOp.GTR: b > c, MatchOp.LTE: b <= c, MatchOp.GTE: b >= c}.get(m.op)
        if ok is None:
            ok = bool(re.fullmatch(x, v)) == (m.op is MatchOp.EQL_REGEX)
        if not ok:
            return False
    return True


@pytest.fixture(scope="module")
def f4(spark):
    rows = [(i + 1, {"n": "m"} | ({} if v is None else {"x": v}), 0, 10) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "tsid long, labels map<string,string>, min_t long, max_t long").cache()


@pytest.mark.parametrize("op", list(MatchOp))
def test_truth_table(f4, op):
    columns = []
    cases = [(x, reject, ms) for x in ["", "a", "ab", "abcdefA", "b", "é", "5", "."] for reject in (False, True) for ms in ([Matcher(op, "x", x)], [eq("n", "m"), Matcher(op, "x", x)])]
    from marlstone.plans.matchers import compile_matchers

    for k, (_, reject, ms) in enumerate(cases):
        columns.append(compile_matchers(ms, lambda n: F.col("labels")[n], "reject" if reject else "pass").alias(f"c{k}"))
    for row in f4.select("labels", *columns).collect():
        for k, (x, reject, ms) in enumerate(cases):
            assert row[f"c{k}"] is passes(ms, row["labels"], reject), (op, x, reject, row["labels"])


def test_ways_and_orders_agree(spark):
    random.seed(4)
    sets = [{n: random.choice("abc5é") for n in "pqrs" if random.random() < 0.7} for _ in range(80)]
    df = spark.createDataFrame([(i + 1, s, i, i + 5) for i, s in enumerate(sets)], "tsid long, labels map<string,string>, min_t long, max_t long").cache()
    for k in range(6):
        ms = [Matcher(random.choice(list(MatchOp)), random.choice("pqrs"), random.choice(["a", "b", "5", "a|b"])) for _ in range(1 + k % 3)]
        want = {i + 1 for i, s in enumerate(sets) if passes(ms, s) and i < 60 and i + 5 >= 10}
        for way, order in itertools.product(STRATEGIES, (ms, ms[::-1])):
            assert {r[0] for r in resolve(df, order, 10, 60, strategy=way).collect()} == want, (ms, way)


def test_interval_is_half_open(f4):
    everything = [neq("n", "none"), eq("n", "m")]
    assert resolve(f4, everything, 10, 11).count() == len(VALUES)
    assert resolve(f4, everything, 11, 12).count() == 0
    assert resolve(f4, everything, -5, 0).count() == 0
    assert resolve(f4, everything, -5, 1).count() == len(VALUES)
    assert resolve(f4, [], 0, 5).count() == 0


def test_present_values_split_in_two(f4):
    one, other = resolve(f4, [eq("x", "a")]), resolve(f4, [neq("x", "a")])
    assert one.union(other).count() == sum(v is not None for v in VALUES) and one.intersect(other).count() == 0


def test_negate_and_bad_input():
    for op in MatchOp:
        m = Matcher(op, "x", "a")
        assert m.negate().negate() == m and m.negate() != m
    for bad in ("(?=a)", r"(a)\1", "(?>a)", "a++", "(?<!a)b", r"\R", r"\h+", "a*+", "a**", r"\Z", "(a", "[a", "[[:odd:]]"):
        with pytest.raises(ValueError):
            matches("x", bad)
    with pytest.raises(TypeError):
        Matcher("=", "x", "a")
    with pytest.raises(ValueError):
        label_set([("a", "1"), ("a", "2")])
    with pytest.raises(TypeError):
        label_set({"a": 1})


def test_selector():
    assert parse_selector('up{job="a\\"b", x!~\'c.*\',}') == [eq("__name__", "up"), eq("job", 'a"b'), Matcher(MatchOp.NEQ_REGEX, "x", "c.*")]
    assert parse_selector("up") == [eq("__name__", "up")] and parse_selector("{}") == []
    assert [m.op for m in parse_selector('{a="1",b!="1",c<"1",d>"1",e<="1",f>="1",g=~"1",h!~"1"}')] == list(MatchOp)
    for bad in ("", 'up{a="1"', 'up{a~"1"}', 'up{a="1" b="2"}', "up{} x"):
        with pytest.raises(ValueError):
            parse_selector(bad)


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        (r"\*+", ["***"], ["", "a"]), ("[*+]x", ["*x", "+x"], ["x"]), (r"a\?+", ["a??"], ["a"]), ("[a&&b]", ["a", "&", "b"], ["c", ""]), (r"[[:alpha:]_]+", ["ab_"], ["a1", ":"]), (r"a\sb", ["a b", "a\tb"], ["a\x0bb"]),
        (r"a\vb", ["a\x0bb"], ["a\nb"]), ("a.b", ["a\u2028b", "a\rb"], ["a\nb"]), (r"\Qa.b\E", ["a.b"], ["axb"]), ("(?P<x_y>a)b$", ["ab"], ["ab\n"]), ("x{,2}", ["x{,2}"], ["xx"]), ("[]a]+", ["]a"], ["b"]), (r"a{2,3}?", ["aa", "aaa"], ["a"]),
        (r"\p{Greek}+", ["αβ"], ["ab"]), (r"\p{^Lu}", ["a"], ["A"]), ("(?i)ab", ["AB"], ["b"]), ("[a[b]", ["[", "a"], ["c"]), (r"\x{1F600}", ["😀"], ["x"]),
    ],
)
def test_patterns_mean_what_re2_means(spark, pattern, yes, no):
    from marlstone.plans.matchers import whole

    df = spark.createDataFrame([(v, True) for v in yes] + [(v, False) for v in no], "v string, want boolean")
    assert df.where(F.col("v").rlike(whole(pattern)) != F.col("want")).collect() == []
    import duckdb

    for v, want in [(v, True) for v in yes] + [(v, False) for v in no]:  # DuckDB's engine is RE2
        assert duckdb.execute("select regexp_full_match(?, ?)", [v, pattern]).fetchone()[0] is want, (pattern, v)
