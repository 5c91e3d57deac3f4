"""What the plans must and must not hold."""

import re

import pytest

from marlstone import queries
from marlstone.engine import Engine
from marlstone.model import eq, matches
from marlstone.operators.resolve import resolve
from marlstone.sources import events


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("manual_compact", "recovery", "stream_ingest")])
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    text = plan(queries.queries()[name](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Arrow|Pandas", text)


def test_map_filter_needs_no_shuffle(spark, sf_dir):
    assert "Exchange" not in plan(resolve(events.series(spark, sf_dir, "F3"), [eq("event_type", "click"), matches("user_id", "1.*")], 0, 10**15))


def test_scans_read_what_is_used(spark, sf_dir):
    text = plan(events.samples(spark, sf_dir, "F1"))
    assert "event_id" not in text and "props" not in text


def test_store_prunes(spark, sf_dir, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    engine.append(events.samples(spark, sf_dir, "F3"))
    engine.compact()
    text = plan(engine.store.index()[0].where("name = 'user_id' and value > 'm'"))
    assert re.search(r"PartitionFilters: \[[^\]]*name#\d+ = user_id", text) and "GreaterThan(value,m)" in text
    text = plan(engine.store.samples(None, 1_704_844_800_000, 1_705_449_600_000))
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 19732", text) and "LessThanOrEqual(t,1705449600000)" in text
    assert engine.store.samples(None, 1_704_844_800_000, 1_705_449_600_000).count() == events.sample_rows(spark, sf_dir).where("t between 1704844800000 and 1705449600000").count()
