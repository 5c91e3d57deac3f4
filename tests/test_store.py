"""Registration, persistence, compaction, versions, recovery, streaming."""

import json
import threading
from dataclasses import asdict

import pytest

from marlstone.engine import Engine
from marlstone.model import CheckpointPolicy, eq, gte, matches, neq, not_matches
from marlstone.operators import postings, registry
from marlstone.operators.resolve import STRATEGIES
from marlstone.sources.store import ConflictError, Store
from marlstone.streaming.ingest import ingest

BATCH = "labels map<string,string>, t long, v double"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), BATCH)


def test_numbers_are_dense_and_ordered(spark):
    rows = [({"a": f"{i:04d}"}, i, 1.0) for i in range(500)]
    out = registry.build(batch(spark, *rows), registry.label_order(["a"])).orderBy("tsid").collect()
    assert [(r["tsid"], r["labels"]["a"]) for r in out] == [(i + 1, f"{i:04d}") for i in range(500)]


def test_registration(spark):
    old = registry.build(batch(spark, ({"a": "1"}, 5, 0.0), ({"b": "2", "a": "1"}, 6, 0.0))).cache()
    assert old.count() == 2  # a label set and one that holds it
    got = {tuple(sorted(r["labels"].items())): (r["tsid"], r["inserted"]) for r in registry.register(old, batch(spark, ({"a": "1"}, 9, 0.0), ({"a": "1", "b": "2"}, 9, 0.0), ({"a": "9"}, 9, 0.0))).collect()}
    assert got[(("a", "9"),)] == (3, True)
    assert {got[(("a", "1"),)][0], got[(("a", "1"), ("b", "2"))][0]} == {1, 2} and not got[(("a", "1"),)][1]
    assert registry.exists(old, {"a": "1"}).count() == 1 and registry.exists(old, {"a": "2"}).count() == 0
    assert registry.current_tsid(old).first()[0] == 3
    assert registry.current_tsid(old.limit(0)).first()[0] == 1


def test_keys_tell_sets_apart(spark):
    sets = [{"a": "1:b"}, {"a:": "1b"}, {"a": "", "b": ""}, {"a": ""}, {}, {"ab": ""}, {"a": "b"}]
    assert registry.label_sets(batch(spark, *[(s, 1, 0.0) for s in sets])).count() == len(sets)


def test_bitmaps(spark):
    ids = [1, 7, 8, 9, 32_768, 32_769, 70_000]
    rows = spark.createDataFrame([("n", "v", i) for i in ids] + [("n", "w", i) for i in ids[2:]], "name string, value string, tsid long")
    maps = postings.bitmaps(rows)
    assert {(r["value"], r["n"]) for r in postings.bitmap_counts(maps).collect()} == {("v", 7), ("w", 5)}
    assert sorted(r[0] for r in postings.bitmap_tsids(maps.where("value = 'v'")).collect()) == ids
    assert sorted(r[0] for r in postings.bitmap_tsids(postings.bitmap_and(maps.select("bucket", "bits"), 2)).collect()) == ids[2:]
    assert sorted(r[0] for r in postings.bitmap_tsids(postings.bitmap_or(maps.select("bucket", "bits"))).collect()) == ids
    assert postings.cardinality(rows).first()[0] == 7
    assert postings.layout(rows).first()["layout"] == "list"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def test_life_of_a_store(spark, engine, tmp_path):
    assert engine.current_tsid() == 1 and engine.resolve("{a=\"1\"}").count() == 0
    app = engine.appender()
    app.add({"__name__": "m", "a": "1"}, 10, 1.0)
    app.add({"__name__": "m", "a": "1"}, 20, 2.0)
    app.add({"__name__": "m", "a": "2", "b": "x"}, 30, 3.0)
    assert app.commit().version == 1 and app.commit().version == 1
    assert engine.current_tsid() == 3
    asked = [([eq("__name__", "m"), neq("b", "x")], None, None), ([eq("a", "2")], 0, 30), ([eq("a", "2")], 30, 31), ([neq("b", "y")], None, None)]

    def answers():
        return [[sorted(r[0] for r in engine.resolve(m, s, e, way).collect()) for way in STRATEGIES] for m, s, e in asked]

    before = answers()
    assert all(a == b == c for a, b, c in before) and [len(x[0]) for x in before] == [1, 0, 1, 1]
    m = engine.compact()
    assert m.version == 2 and not m.hot and m.compacted_tsid == 2 and m.compacted_t == 30
    assert answers() == before and engine.compact().version == 2
    engine.append(batch(spark, ({"__name__": "m", "a": "1"}, 99, 9.0), ({"__name__": "k"}, 5, 7.0)), "b1")
    assert engine.append(batch(spark, ({"__name__": "z"}, 1, 1.0)), "b1").version == 3
    assert engine.current_tsid() == 4
    one = engine.exists({"__name__": "m", "a": "1"})
    assert engine.series_labels(one) == {"__name__": "m", "a": "1"} and engine.series_labels(77) is None and engine.exists({"a": "1"}) is None
    assert {r[0] for r in engine.label_values("a").collect()} == {"1", "2"} and engine.label_names().count() == 3
    q = engine.querier(10, 99)
    assert sorted((r["t"], r["v"]) for r in q.select([eq("a", "1")]).collect()) == [(10, 1.0), (20, 2.0), (99, 9.0)]
    assert engine.querier(11, 98).select([eq("a", "1")]).count() == 1
    assert [(k, [r["t"] for r in rows]) for k, rows in q.series('m{a="1"}')] == [(one, [10, 20, 99])]
    assert {r["labels"]["a"] for r in q.select_with_labels("m").collect()} == {"1", "2"}
    assert [r[0] for r in engine.postings("a", "1").collect()] == [one]
    past = engine.at_version(1)
    assert past.current_tsid() == 3 and past.resolve('{__name__="k"}').count() == 0
    with pytest.raises(ValueError):
        past.append(batch(spark, ({"a": "1"}, 1, 1.0)))
    engine.compact()
    assert engine.resolve([eq("a", "1")], 50, 60).collect() == engine.resolve([eq("a", "1")], 50, 60, "postings").collect()
    gone = engine.store.vacuum()
    assert gone and engine.querier(0, 100).select("m").count() == 4
    with pytest.raises(KeyError):
        engine.at_version(1)
    assert "sum" in engine.print_stats()


def test_unpublished_folders_don_t_count(spark, engine, monkeypatch):
    engine.append(batch(spark, ({"a": "1"}, 1, 1.0)))
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda self, x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            engine.append(batch(spark, ({"a": "2"}, 2, 2.0)))
    again = Engine(spark, engine.store.folder.path)
    assert again.current_tsid() == 2 and again.querier(0, 9).select([neq("a", "")]).count() == 1
    assert again.append(batch(spark, ({"a": "2"}, 2, 2.0))).tsid == 2
    assert len([g for g in again.store.vacuum(keep=9) if g.startswith(("touched", "hot_samples"))]) == 2


def test_second_writer_loses(spark, engine):
    m = engine.append(batch(spark, ({"a": "1"}, 1, 1.0)))
    with pytest.raises(ConflictError):
        engine.store._publish(m)


def test_policies(spark, tmp_path, capfd):
    rows = [({"a": str(i)}, i, 0.0) for i in range(5)]
    off = Engine(spark, str(tmp_path / "off"), CheckpointPolicy.DISABLED, compact_after=2)
    assert off.append(batch(spark, *rows)).hot and not off.compact().hot
    said = Engine(spark, str(tmp_path / "said"), CheckpointPolicy.PRINT, compact_after=2)
    assert not said.append(batch(spark, *rows)).hot
    assert "6,b" in (err := capfd.readouterr().err) and "6,e" in err


def rows_of(df):
    return sorted(r[0] for r in df.collect())


def many(n, first=0):
    """Label sets of which some names fill bitmaps and others stay lists."""
    return [({"__name__": "m", "id": f"{i:05d}", "kind": "ab"[i % 2], **({"odd": "x"} if i % 3 == 0 else {})}, first + i, float(i)) for i in range(n)]


@pytest.mark.parametrize("bitmap_only", [False, True])
def test_strategies_read_the_compacted_index(spark, tmp_path, bitmap_only):
    """Three ways, over epochs and a hot part, with and without times, as a plain reading has it."""
    engine = Engine(spark, str(tmp_path / "s"), bitmap_only=bitmap_only)
    data = [many(700), many(300, 5000), many(40, 9000)]
    for rows in data[:2]:
        engine.append(batch(spark, *rows))
        engine.compact()
    engine.append(batch(spark, *data[2]))
    m = engine.store.manifest()
    kinds = [{"postings", "bitmaps"} & set(e[4]) for e in m.epochs]
    assert kinds == ([{"bitmaps"}] * 2 if bitmap_only else [{"postings", "bitmaps"}, {"postings"}])  # the rule picks by size
    spans = {}
    for rows in data:
        for labels, t, _ in rows:
            spans.setdefault(tuple(sorted(labels.items())), []).append(t)
    ids = {tuple(sorted(r["labels"].items())): r["tsid"] for r in engine.store.series().collect()}
    asked = [[eq("kind", "a")], [eq("kind", "a"), neq("odd", "x")], [matches("id", "0000.|0001."), eq("kind", "b")], [neq("kind", "a")], [gte("id", "00690")], [eq("kind", "a"), eq("odd", "y")], [eq("odd", "x"), not_matches("id", ".*5")]]
    import re

    test = {"=": lambda v, x: v == x, "!=": lambda v, x: v != x, ">=": lambda v, x: v is not None and v >= x, "=~": lambda v, x: v is not None and re.fullmatch(x, v), "!~": lambda v, x: v is not None and not re.fullmatch(x, v)}
    ranges = [(None, None), (0, 100), (699, 5001), (800, 5000), (5290, 9001), (9039, None), (None, 1)]
    for k, ms in enumerate(asked):
        for start, end in (ranges[k % 7], ranges[(3 * k + 2) % 7]):
            want = sorted(ids[k] for k, ts in spans.items() if all(test[m.op.value](dict(k).get(m.name), m.value) for m in ms) and any((end is None or t < end) and (start is None or t >= start) for t in ts))
            for way in ("map", "postings", "bitmap"):
                assert rows_of(engine.resolve(ms, start, end, way)) == want, (ms, start, end, way)
    q = [engine.querier(5000, 9010, way).select([eq("kind", "a"), eq("odd", "x")]) for way in ("map", "postings", "bitmap")]
    assert sorted(map(tuple, q[0].collect())) == sorted(map(tuple, q[1].collect())) == sorted(map(tuple, q[2].collect())) and q[0].count() == 52
    assert rows_of(engine.label_values("kind")) == ["a", "b"] and rows_of(engine.label_names()) == ["__name__", "id", "kind", "odd"]
    assert engine.postings("kind", "a").count() == 350


def test_epochs_out_of_range_aren_t_read(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    for first in (0, 10_000, 20_000):
        engine.append(batch(spark, *many(50, first)))
        engine.compact()
    m = engine.store.manifest()
    for kind in m.epochs[1][4]:
        files = engine.store.epochs(m, kind, 10_000, 10_050).inputFiles()
        assert len(files) and all(m.epochs[1][0] in f for f in files)
    assert engine.resolve([eq("kind", "a")], 500, 9_000, "postings").count() == 0 and engine.resolve([eq("kind", "a")], 9_000, 10_001, "bitmap").count() == 1
    files = engine.resolve([eq("kind", "a")], 10_000, 10_050, "bitmap").inputFiles()
    assert any(m.epochs[1][0] in f and "postings" in f for f in files) and not any(e[0] in f and "series" not in f for f in files for e in (m.epochs[0], m.epochs[2]))


def test_many_commits_leave_a_small_manifest(spark, tmp_path, monkeypatch):
    """36 commits, with merges of 3: the lists, the manifest and the plan stay as small as after 20, and nothing is lost."""
    monkeypatch.setattr("marlstone.sources.store.FAN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    engine = Engine(spark, str(tmp_path / "s"), hot_commits=3, keep=8)
    sizes, plans = [], []
    for k in range(36):
        m = engine.append(spark.createDataFrame([({"id": str(k % 30), "b": str(k)}, k, 1.0)], BATCH).coalesce(1), f"stream/{k}")
        sizes.append(len(json.dumps(asdict(m))))
        plans.append(len(engine.store.index()[0]._jdf.queryExecution().analyzed().toString().split("\n")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(sizes[20:]) < 2 * max(sizes[:20]) and max(plans[20:]) <= max(plans[:20]) < 30
    assert m.tsid == 36 and len(m.epochs) < 4 * 3 and len(m.segments) < 4 * 3 and m.streams == {"stream": 35} and not m.batches
    assert engine.append(batch(spark, ({"z": "1"}, 1, 1.0)), "stream/20") == m
    assert len(engine.store.versions()) <= 8 + 5
    assert engine.querier(0, 999).select([eq("id", "7")]).count() == 1 and engine.store.samples().count() == 36
    assert engine.resolve([eq("id", "7")], 7, 8, "postings").count() == 1


def test_commits_read_touched_folders(spark, engine):
    engine.append(batch(spark, *many(300)))
    engine.compact()
    key = registry.key_of(many(8)[7][0])
    files = engine.store.series(None, key)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files and "bucket#" in files
    assert engine.store._cold_series(engine.store.manifest()).select("bucket").distinct().count() > 30
    assert engine.exists(many(8)[7][0]) is not None and engine.exists({"__name__": "m"}) is None
    m = engine.append(batch(spark, *many(301)[299:]))
    assert m.tsid == 301


def test_null_labels(spark, engine):
    """A label without a value is absent; a row without a label set or a time is refused."""
    engine.append(batch(spark, ({"a": None, "b": "1"}, 1, 1.0), ({"b": "1"}, 2, 2.0)))
    assert engine.current_tsid() == 2 and engine.exists({"b": "1"}) == 1 and engine.querier(0, 9).select([eq("b", "1")]).count() == 2
    for bad in ((None, 1, 1.0), ({"a": "1"}, None, 1.0)):
        with pytest.raises(ValueError):
            engine.append(batch(spark, ({"a": "2"}, 1, 1.0), bad))
    assert engine.current_tsid() == 2 and engine.store.manifest().version == 1
    assert registry.label_sets(batch(spark, ({"a": None, "b": "1"}, 1, 1.0), ({"b": "1"}, 2, 2.0), (None, 3, 3.0))).count() == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    folder = Store(spark, str(tmp_path / "s")).folder
    for k in range(25):
        won = []
        threads = [threading.Thread(target=lambda i=i: won.append(folder.publish(f"v{k}", str(i), f".scratch-{k}-{i}"))) for i in range(6)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert sum(won) == 1 and folder.read(f"v{k}") in map(str, range(6))
    assert not [n for n in folder.names() if "scratch" in n and not n.endswith(".crc")]
    one, other = (Engine(spark, str(tmp_path / "t")) for _ in range(2))
    failed = []

    def write(e, label):
        try:
            e.append(batch(spark, ({"w": label}, 1, 1.0)))
        except ConflictError as x:
            failed.append(x)

    threads = [threading.Thread(target=write, args=(e, str(k))) for k, e in enumerate((one, other))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    m = one.store.manifest()
    assert m.version + len(failed) == 2 == m.tsid + len(failed)


def test_compaction_in_the_background(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), hot_commits=2, background=True)
    for k in range(7):
        engine.append(batch(spark, ({"id": str(k)}, k, 1.0)))
    m = engine.wait()
    assert m.tsid == 7 and m.epochs and engine.store.samples().count() == 7 and engine.resolve([neq("id", "none")]).count() == 7
    assert engine.compact().hot == [] and engine.querier(0, 9).select([neq("id", "none")]).count() == 7


def test_caches_are_bounded(spark, engine, monkeypatch):
    monkeypatch.setattr("marlstone.engine.CACHED", 2)
    engine.append(batch(spark, *many(4)))
    assert [engine.exists(many(4)[k][0]) for k in (0, 1, 2, 0)].count(None) == 0 and len(engine._tsids) == 2
    first = engine.series_labels(1)
    first["x"] = "changed"
    monkeypatch.setattr(engine.store, "series", None)
    assert "x" not in engine.series_labels(1)


def test_empty_batch(spark, engine):
    assert engine.append(batch(spark, ({"a": "1"}, 1, 1.0)).limit(0)).version == 0


def test_stream_is_batch(spark, tmp_path):
    rows = [({"a": str(i % 7), **({"b": "y"} if i % 3 else {})}, i, float(i)) for i in range(60)]
    for k in range(3):
        batch(spark, *rows[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one, other = Engine(spark, str(tmp_path / "one")), Engine(spark, str(tmp_path / "other"))
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, one.store, str(tmp_path / "cp")).awaitTermination()
    n = one.store.manifest().version
    ingest(stream, one.store, str(tmp_path / "cp")).awaitTermination()
    other.append(batch(spark, *rows))
    assert one.store.manifest().version == n == 3 and one.current_tsid() == other.current_tsid()
    flat = lambda e: sorted((sorted(r["labels"].items()), r["t"], r["v"]) for r in e.querier(0, 99).select_with_labels([neq("a", "none")]).collect())
    assert flat(one) == flat(other) and len(flat(one)) == 60
