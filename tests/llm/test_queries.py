"""The registered queries against DuckDB, and the pipeline against plain versions."""

import duckdb
import pytest

import corpus_pipeline
from marlstone.llm import queries

from . import plain
from .test_jaccard import least_ids, shingles


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in out.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_one_row_a_document(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.queries()[name](spark, sf_dir)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_pipeline(spark, sf_dir, tmp_path):
    """Each stage on its own input, as the plain versions have it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() == len(got)
        if name == "exact_dedup":
            assert got == {keep for keep, _ in plain.equal_texts(rows).values()}
        elif name == "near_dedup":
            assert sorted(got) == least_ids(rows)
        elif name == "decontamination":
            assert got == {i for i, t in rows if not plain.contamination(t, items)[1]}
        elif name == "mixing":
            assert all(r["taken"] > 0 for r in docs.collect())
        else:
            assert 0.7 * len(rows) < len(got) < len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == got


def classes(rows):
    """The number of the component that each row is in, by similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for p in range(len(rows)):
        for q in range(p):
            if root[p] != root[q] and (sets[p] == sets[q] or 5 * len(sets[p] & sets[q]) >= 4 * len(sets[p] | sets[q])):
                old, new = root[p], root[q]
                root = [new if r == old else r for r in root]
    return root


def test_pipeline_on_odd_rows(spark, odd, labels, benchmark, items, tmp_path):
    """Nulls in any column, repeats, ties, empty and long texts, clashing names: each stage as a plain reading of its own input."""
    d = str(tmp_path / "odd")
    for name, df in (("documents", odd), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{d}/{name}.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            after = [(r["doc_id"], r["text"]) for r in rows]
            assert docs.columns == odd.columns and not set(after) - set(before)
        if name == "toxicity":
            bad = lambda t: any(w in (t or "") for w in ("vilegrub", "mudbrain"))
            assert sorted(map(repr, after)) == sorted(repr(x) for x in before if not bad(x[1]))
        elif name == "exact_dedup":
            assert sorted(repr((i, plain.lower(t))) for i, t in after) == sorted(repr((keep, t)) for t, (keep, _) in plain.equal_texts(before).items())
        elif name == "near_dedup":
            root = classes(before)
            least = {}
            for c, (i, t) in zip(root, before, strict=True):
                least[c] = min(least.get(c, (True, 0)), (i is None, i or 0))
            assert sorted((i is None, i or 0) for i, _ in after) == sorted(least.values())
        elif name == "decontamination":
            assert sorted(map(repr, after)) == sorted(repr(x) for x in before if not plain.contamination(x[1], items)[1])
        else:
            assert 0 < len(rows) <= len(before) and all(r["taken"] > 0 for r in rows)
    assert sorted(map(repr, corpus_pipeline.run(spark, d).select("doc_id", "taken").collect())) == sorted(map(repr, docs.select("doc_id", "taken").collect()))


def test_pipeline_on_no_rows(spark, odd, labels, benchmark, tmp_path):
    for k, (a, b, c) in enumerate([(0, 1, 1), (1, 0, 0)]):
        d = str(tmp_path / str(k))
        for name, df, full in (("documents", odd, a), ("labels", labels, b), ("benchmark", benchmark, c)):
            (df if full else df.limit(0)).write.parquet(f"{d}/{name}.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and (out.count() > 0) == bool(a)
