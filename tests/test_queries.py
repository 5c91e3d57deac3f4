"""Each query of the engine against its oracle in DuckDB."""

import datetime
import math

import duckdb
import pytest

from marlstone import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else str(x) if isinstance(x, datetime.datetime) else x
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_oracle(spark, duck, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    want = duck.sql(queries.oracle_sql()[name])
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_an_oracle():
    assert queries.queries().keys() == queries.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= queries.queries().keys()
