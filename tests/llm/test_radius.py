"""Links of fingerprints under radii other than the query's."""

import random

import numpy as np
import pytest

from marlstone.llm import simhash


@pytest.mark.parametrize("radius,fixed", [(0, None), (3, None), (4, None), (6, None), (3, 5), (3, 9)])
def test_links_reach_the_radius(spark, radius, fixed):
    """Pairs whose differing bits stand far apart, one in each block."""
    g = random.Random(radius)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = [(a := g.getrandbits(64), a ^ sum(1 << (64 * k // max(radius, 1) + g.randint(0, 8)) for k in range(radius))) for _ in range(40)]
    links = simhash.links(spark.createDataFrame([(sign(x),) for p in pairs for x in set(p)], "fp long"), radius, fixed).collect()
    assert {frozenset((r["a"], r["b"])) for r in links} == {frozenset(map(sign, p)) for p in pairs if radius}


def test_radius_too_wide():
    with pytest.raises(ValueError):
        simhash.grid_masks(30)


def test_more_fingerprints_fix_more_blocks():
    fixed = [simhash.fixed_for(n) for n in (0, 10**6, 10**8, 10**10)]
    assert fixed[0] == 3 and fixed == sorted(fixed) and fixed[-1] > fixed[0]
    # Strangers that a random fingerprint meets, at most, with 100 and 10,000 times as many.
    met = lambda n: len(simhash.grid_masks(3, f := simhash.fixed_for(n))) * n * 2 ** (-1.4 * 32 * f / (3 + f))
    assert met(10**8) < 60 and met(10**10) < 5000


def made(df):
    """The rows that the executed plan's generators and joins made."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    left = [plan]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        left += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        if kind.startswith("Generate") or "Join" in kind:
            total += node.metrics().get("numOutputRows").get().value()
    return total


def test_rows_follow_the_fingerprints(spark):
    """Five times the fingerprints, whose cells go from seldom shared to mostly shared, and then to large, make five times the rows."""
    g = random.Random(4)
    fps = list({sum(g.getrandbits(2) << 4 * k for k in range(16)) for _ in range(10_000)})
    rows = []
    for n in (60, 300, 1500, 7500):
        found = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps[:n]], "fp long").repartition(4), 2, 3)
        found.collect()
        rows.append(made(found))
    assert rows == [10 * n for n in (60, 300, 1500, 7500)]


@pytest.mark.parametrize("small,block", [(3, 4), (8, 50), (64, 1 << 15)])
@pytest.mark.parametrize("radius", [0, 3, 5])
def test_links_within_cells(small, block, radius, monkeypatch):
    """Strangers, clouds and chains in small and large cells: the links connect just what all pairs within the radius do."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    g = random.Random(radius)
    cells, fps, root = [], [], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for c, n in enumerate([1, 2, 5, 30, 70, 300, 1, 2]):
        x, own = g.getrandbits(64), set()
        for _ in range(n):
            y = x ^ sum(1 << b for b in g.sample(range(64), g.choice([0, 1, 3, 5, 9, 20])))
            own.add(y)
            x = y if g.random() < 0.2 else x
        own = sorted(own)
        cells += [c] * len(own)
        fps += own
        for i, a in enumerate(own):
            for b in own[:i]:
                if (a ^ b).bit_count() <= radius:
                    root[find(a)] = find(b)
    want = {frozenset(f for f in fps if find(f) == r) for r in {find(f) for f in fps}}
    a, b = simhash._links_of(np.array(cells), np.array(fps, np.uint64), radius)
    assert all((x ^ y).bit_count() <= radius for x, y in zip(a.tolist(), b.tolist(), strict=True)) and len(a) == len(fps) - len(want)
    root = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    assert {frozenset(f for f in fps if find(f) == r) for r in {find(f) for f in fps}} == want


def test_a_dense_cell_is_not_compared_in_pairs(monkeypatch):
    """Four times the members of a cell where all are near: far from sixteen times the comparisons."""
    compared, count = [0], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.__setitem__(0, compared[0] + np.size(x)), count(x))[1])
    g, took = np.random.default_rng(1), []
    for n in (2000, 8000):
        fps = np.zeros(n, np.uint64)
        for _ in range(3):
            fps ^= np.uint64(1) << g.integers(0, 64, n).astype(np.uint64)
        fps, compared[0] = np.unique(fps), 0
        assert len(simhash._links_of(np.zeros(len(fps), np.int64), fps, 5)[0]) == len(fps) - 1
        took.append(compared[0])
    assert took[1] < 8 * took[0] and took[1] < 20 * 8000
