"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

import random
import re
from itertools import combinations

import pytest
import xxhash

import corpus_pipeline
from marlstone.llm import jaccard

from . import plain


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", plain.lower(t))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_ids(rows):
    """The least id of each component of pairs with similarity 0.8 or more."""
    sets, root = [(i, shingles(t)) for i, t in rows], list(range(len(rows)))
    for (p, (_, a)), (q, (_, b)) in combinations(enumerate(sets), 2):
        if 5 * len(a & b) >= 4 * len(a | b) and root[p] != root[q]:
            old, new = root[q], root[p]
            root = [new if r == old else r for r in root]
    return sorted(min(i for (i, _), r in zip(rows, root, strict=True) if r == x) for x in set(root))


def made(n):
    """Texts with edits about the limit, a chain of them, a large group, a line that many share, and short ones."""
    g = random.Random(n)
    words = lambda k: [f"w{g.randint(0, 5000)}" for _ in range(k)]
    line, texts = words(40), [None, "", " \n", "one", "One", "one two", "a b c d e", "a b c d e f"]
    for k in range(60):
        base = words(g.choice([6, 12, 40, 150, 600]))
        texts.append(" ".join(base))
        for _ in range(g.randint(0, 3)):
            new = list(base)
            for _ in range(g.randint(0, max(1, len(base) // 30))):
                new[g.randrange(len(new))] = "edit" + str(g.random())
            texts.append(" ".join(new))
    texts += [" ".join(words(g.choice([0, 8, 60])) + line) for _ in range(30)]
    base = words(120)
    for k in range(40):
        base = base if k % 4 else [*base[3:], *words(3)]
        texts.append(" ".join(base) + f" tail{k}")
    g.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n", [1, 2])
def test_keep_one(spark, n, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", n)
    rows = made(n)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), None)
    assert sorted(r["doc_id"] for r in kept.collect()) == least_ids(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_keep_one_of_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    docs = corpus_pipeline.exact_dedup(spark, docs, None)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, None).collect())
    assert got == least_ids([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeated_ids_and_none(spark):
    rows = [(5, "one text of seven words in all"), (5, "and some other text altogether than that"), (5, "one text of seven words in all"), (7, "ONE text of seven words in all"), (None, "alone with no id"), (None, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[4], rows[5]]))
    assert jaccard.keep_one(kept.limit(0)).count() == 0


def majority(t):
    """The fingerprint of the set of a text's five-word shingles."""
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles(t)]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def test_near_fingerprints(spark, monkeypatch):
    """The stage takes its pairs from the fingerprints' grids: they connect all within the radius, and the stage links by them."""
    rows = [(i, t) for i, t in made(3) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.sets(docs).cache()
    of = {r["doc_id"]: r["cls"] for r in sets.collect()}
    fps = {r["doc_id"]: r["fp"] % (1 << 64) for r in sets.collect()}
    assert fps == {i: majority(t) for i, t in rows}

    def joined(links):
        root = {c: c for c in of.values()}
        for a, b in links:
            if root[a] != root[b]:
                old, new = root[a], root[b]
                root = {c: new if r == old else r for c, r in root.items()}
        return {frozenset(c for c in root if root[c] == r) for r in set(root.values())}

    near = [(of[i], of[j]) for i, j in combinations(of, 2) if of[i] != of[j] and (fps[i] ^ fps[j]).bit_count() <= jaccard.RADIUS]
    got = [(r["a"], r["b"]) for r in jaccard.near_fingerprints(sets).collect()]
    assert near and joined(got) == joined(near)

    # Without the exact way for the rest, what the fingerprints link still goes.
    monkeypatch.setattr(jaccard, "SEEDS", 0)
    monkeypatch.setattr(jaccard, "_across", lambda cell: iter(()))
    kept = corpus_pipeline.near_dedup(spark, docs, None).count()
    assert len(least_ids(rows)) <= kept < len(set(of.values()))
