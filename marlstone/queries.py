"""One query for each operator of the engine, over the ``events`` table, with its oracle in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.storage import settle, shared_dir
from .model import NAME, Matcher, eq, gt, gte, lt, lte, matches, neq, not_matches
from .operators import activity, postings, registry, select, values
from .operators.resolve import resolve
from .sources import events
from .streaming.ingest import ingest

#: 2024-01-10 and 2024-01-17, UTC; epochs are weeks from 2024-01-01.
A, B, ORIGIN = 1_704_844_800_000, 1_705_449_600_000, 1_704_067_200_000

Query = Callable[[SparkSession, str], DataFrame]


def _f(which: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: events.series(spark, d, which)


F1, F2, F3 = _f("F1"), _f("F2"), _f("F3")


def _x1(spark: SparkSession, d: str) -> DataFrame:
    return events.numbered(spark, d, "F1")


def _p3(spark: SparkSession, d: str) -> DataFrame:
    return postings.postings(F3(spark, d))


def _match(*ms: Matcher, strategy: str = "map", neq_absent: str = "pass") -> Query:
    return lambda spark, d: resolve(F3(spark, d), ms, neq_absent=neq_absent, strategy=strategy)


def _flat(*names: str) -> list[Column]:
    return [F.col("labels")[n].alias(n) for n in names]


def series_with_labels(spark: SparkSession, d: str) -> DataFrame:
    out = select.series_with_labels(F1(spark, d), _x1(spark, d), [eq("event_type", "error"), lt("user_id", "2")], A, B)
    return out.select("tsid", *_flat("event_type", "user_id"), "t", "v")


def select_series(spark: SparkSession, d: str) -> DataFrame:
    return select.select_series(F1(spark, d), _x1(spark, d), [eq("event_type", "click"), matches("user_id", "1|2|3")], A, B)


def _before(spark: SparkSession, d: str) -> DataFrame:
    return events.samples(spark, d, "F1").where(F.col("t") < A)


def _after(spark: SparkSession, d: str) -> DataFrame:
    return events.samples(spark, d, "F1").where(F.col("t") >= A)


def _old(spark: SparkSession, d: str) -> DataFrame:
    return settle(registry.build(_before(spark, d), registry.label_order(events.SETS["F1"])))


def add_series_existing(spark: SparkSession, d: str) -> DataFrame:
    out = registry.existing(_old(spark, d), _after(spark, d))
    return out.select(*_flat("event_type", "user_id"))


def add_series_new(spark: SparkSession, d: str) -> DataFrame:
    out = registry.new(_old(spark, d), _after(spark, d), registry.label_order(events.SETS["F1"]))
    return out.select("tsid", *_flat("event_type", "user_id"))


_KEPT: dict[tuple, Engine] = {}
#: The stores that queries read: label set, and the time that parts the first commit, which is compacted, from the second, which is hot.
STORES = (("F1", A), ("F1", B), ("F3", A))


def kept_store(spark: SparkSession, d: str, which: str, cut: int) -> Engine:
    """A store of two commits, built once a session."""
    at = (spark.sparkContext.applicationId, d, which, cut)
    if at not in _KEPT:
        engine, rows = Engine(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), events.samples(spark, d, which)
        engine.append(rows.where(F.col("t") < cut), "events/0")
        engine.compact()
        engine.append(rows.where(F.col("t") >= cut), "events/1")
        engine.append(rows.where(F.col("t") >= cut), "events/1")  # a batch that comes again counts once
        _KEPT[at] = engine
    return _KEPT[at]


def _as_in_registry(spark: SparkSession, d: str, engine: Engine, rows: DataFrame) -> DataFrame:
    """``rows`` of a store's numbers with the numbers that the registry F1 has for the same label sets."""
    names = engine.store.series().select("tsid", "key").join(F1(spark, d).select("key", F.col("tsid").alias("own")), "key")
    return rows.join(names.select("tsid", "own"), "tsid").drop("tsid").withColumnRenamed("own", "tsid")


def at_version(spark: SparkSession, d: str) -> DataFrame:
    """The registry as the store's first version has it."""
    return kept_store(spark, d, "F1", A).at_version(1).store.series(1).select(*_flat("event_type", "user_id"))


def append_samples(spark: SparkSession, d: str) -> DataFrame:
    """What two appends have left in a store."""
    engine = kept_store(spark, d, "F1", A)
    out = engine.store.samples().groupBy("tsid").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("sum_v"))
    return _as_in_registry(spark, d, engine, out).select("tsid", "n", "sum_v")


def hot_cold_union(spark: SparkSession, d: str) -> DataFrame:
    """A posting list of the cold tier, as rows or bitmaps, and that of the hot tier."""
    engine = kept_store(spark, d, "F1", B)
    m = engine.store.manifest()
    asked = (F.col("name") == "event_type") & (F.col("value") == "click")
    cold = engine.store.epochs(m, "postings").where(asked).select("tsid").union(postings.bitmap_tsids(engine.store.epochs(m, "bitmaps").where(asked)))
    hot = postings.of(postings.postings(engine.store.touched(m)), "event_type", "click")
    return _as_in_registry(spark, d, engine, postings.either(cold, hot)).select("tsid")


def _store_resolve(strategy: str) -> Query:
    """A selector and a time range over a compacted store with a hot part."""

    def of(spark: SparkSession, d: str) -> DataFrame:
        engine = kept_store(spark, d, "F3", A)
        tsids = engine.resolve([eq("event_type", "purchase"), neq("band", "low"), lt("user_id", "5")], A, B, strategy)
        return engine.store.series().join(tsids, "tsid", "left_semi").select(*_flat("event_type", "user_id", "band"))

    return of


def _store_select(strategy: str) -> Query:
    def of(spark: SparkSession, d: str) -> DataFrame:
        out = kept_store(spark, d, "F3", A).querier(A, B, strategy).select_with_labels([eq("event_type", "error"), lt("user_id", "2")])
        return out.select(*_flat("event_type", "user_id"), "t", "v")

    return of


def store_postings(spark: SparkSession, d: str) -> DataFrame:
    """The postings of two names, whichever way they are kept."""
    engine = kept_store(spark, d, "F3", A)
    asked = F.col("name").isin("event_type", "band")
    rows, maps = engine.store.index()
    every = rows.where(asked).select("name", "value", "tsid").union(postings.bitmap_tsids(maps.where(asked), "name", "value")).distinct()
    return every.groupBy("name", "value").agg(F.count("*").alias("n"))


def postings_list(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).where(F.col("name").isin("event_type", "band")).select("name", "value", "tsid")


def _lists(how: Callable[[DataFrame, DataFrame], DataFrame], first: str, second: str) -> Query:
    def of(spark: SparkSession, d: str) -> DataFrame:
        p = _p3(spark, d)
        return how(postings.of(p, "event_type", first), postings.of(p, "band", second))

    return of


def bitmap_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = F2(spark, d).select(F.col("labels")["k"].alias("k"), "tsid")
    return postings.bitmap_counts(postings.bitmaps(rows, "k"), "k", "bucket")


def _bitmaps(how: Callable[[DataFrame], DataFrame], first: str, second: str) -> Query:
    def of(spark: SparkSession, d: str) -> DataFrame:
        p = _p3(spark, d)
        return postings.bitmap_tsids(how(postings.bitmaps(p.where(((F.col("name") == "event_type") & (F.col("value") == first)) | ((F.col("name") == "band") & (F.col("value") == second))))))

    return of


def seek_samples(spark: SparkSession, d: str) -> DataFrame:
    tsids = resolve(F1(spark, d), [eq("event_type", "signup")])
    return select.seek(_x1(spark, d).join(tsids, "tsid", "left_semi"), B)


def series_set(spark: SparkSession, d: str) -> DataFrame:
    s = select.grouped(_x1(spark, d))
    at = F.col("samples")
    return s.select("tsid", F.size(at).cast("long").alias("n"), F.element_at(at, 1)["t"].alias("first_t"), F.element_at(at, -1)["t"].alias("last_t"))


def _store(spark: SparkSession, d: str, compact: bool) -> Engine:
    """A new store with two commits, the first of them compacted if asked."""
    engine = Engine(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    engine.append(_before(spark, d), "first")
    if compact:
        engine.compact()
    engine.append(_after(spark, d), "second")
    engine.append(_after(spark, d), "second")  # a batch that comes again counts once
    return engine


def manual_compact(spark: SparkSession, d: str) -> DataFrame:
    """Hot and cold together, the same matchers before and after compaction."""
    out = _store(spark, d, True).querier(A, B).select_with_labels([eq("event_type", "error"), lt("user_id", "2")])
    return out.select(*_flat("event_type", "user_id"), "t", "v")


def recovery(spark: SparkSession, d: str) -> DataFrame:
    """A store opened anew: the registry that its manifest and log give."""
    path = _store(spark, d, False).store.folder.path
    return Engine(spark, path).store.series().select(*_flat("event_type", "user_id"), F.col("created_t"))


def store_at_version(spark: SparkSession, d: str) -> DataFrame:
    """The samples that the compacted second version of a store reads, beside the third."""
    engine = kept_store(spark, d, "F1", A).at_version(2)
    return engine.querier(0, 2 * B).select_with_labels([eq("event_type", "error")]).select(*_flat("event_type", "user_id"), "t", "v")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream into a store."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = events.sample_rows(spark, d, spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    labelled = events.labelled(stream, "F1")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    engine = Engine(spark, f"{path}/store")
    ingest(labelled, engine.store, f"{path}/checkpoint", name=f"ingest_{uuid.uuid4().hex}").awaitTermination()
    out = engine.querier(A, B).select_with_labels([eq("event_type", "error"), lt("user_id", "2")])
    return out.select(*_flat("event_type", "user_id"), "t", "v")


def queries() -> dict[str, Query]:
    return {
        "series_with_labels": series_with_labels,
        "match_eq": _match(eq("event_type", "click")),
        "match_neq": _match(gte("user_id", "5"), neq("band", "low")),
        "match_neq_reject_absent": _match(gte("user_id", "5"), neq("band", "low"), neq_absent="reject"),
        "match_neq_only": _match(neq("event_type", "click"), neq("band", "low")),
        "match_lt": _match(lt("user_id", "5")),
        "match_gt": _match(gt("user_id", "5")),
        "match_lte": _match(lte("user_id", "5")),
        "match_gte": _match(gte("user_id", "5")),
        "match_re": _match(matches("event_type", "cl.*|view")),
        "match_nre": _match(not_matches("band", "l.*")),
        "match_and": _match(eq("event_type", "purchase"), eq("band", "high"), lt("user_id", "5")),
        "match_and_postings": _match(eq("event_type", "purchase"), eq("band", "high"), lt("user_id", "5"), strategy="postings"),
        "match_and_bitmap": _match(eq("event_type", "purchase"), eq("band", "high"), lt("user_id", "5"), strategy="bitmap"),
        "match_neq_postings": _match(gte("user_id", "5"), neq("band", "low"), strategy="postings"),
        "match_empty": _match(),
        "resolve_matchers": lambda s, d: resolve(F1(s, d), [eq("event_type", "click"), matches("user_id", "1.*")], A, B),
        "active_overlap": lambda s, d: activity.active_overlap(F1(s, d), A, B),
        "active_exact": lambda s, d: activity.active_exact(_x1(s, d), A, B),
        "select_series": select_series,
        "series_labels": lambda s, d: registry.series_labels(F3(s, d), 10),
        "series_exists": lambda s, d: registry.exists(F1(s, d), {NAME: events.METRIC, "event_type": "click", "user_id": "1"}),
        "label_values": lambda s, d: values.label_values(_p3(s, d), "band"),
        "label_values_all": lambda s, d: values.label_value_counts(_p3(s, d)),
        "current_tsid": lambda s, d: registry.current_tsid(F1(s, d)),
        "postings_list": postings_list,
        "postings_and": _lists(postings.both, "purchase", "high"),
        "postings_or": _lists(postings.either, "click", "high"),
        "postings_andnot": _lists(postings.without, "purchase", "low"),
        "bitmap_and": _bitmaps(lambda m: postings.bitmap_and(m, 2), "purchase", "high"),
        "bitmap_or": _bitmaps(postings.bitmap_or, "click", "high"),
        "layout_choice": lambda s, d: postings.layout(_p3(s, d)),
        "label_names": lambda s, d: values.label_names(_p3(s, d)),
        "postings_cardinality": lambda s, d: postings.cardinality(postings.of(_p3(s, d), "band", "high")),
        "seek_samples": seek_samples,
        "series_set": series_set,
        "manual_compact": manual_compact,
        "recovery": recovery,
        "store_at_version": store_at_version,
        "stream_ingest": stream_ingest,
        "bitmap_cardinality": lambda s, d: postings.bitmap_counts(postings.bitmaps(_p3(s, d))),
        "bitmap_buckets": bitmap_buckets,
        "posting_intervals": lambda s, d: postings.intervals(_p3(s, d)),
        "compaction_epochs": lambda s, d: activity.epochs(_x1(s, d), ORIGIN),
        "hot_cold_union": hot_cold_union,
        "at_version": at_version,
        "add_series_existing": add_series_existing,
        "add_series_new": add_series_new,
        "append_samples": append_samples,
        **{f"store_resolve_{way}": _store_resolve(way) for way in ("map", "postings", "bitmap")},
        **{f"store_select_{way}": _store_select(way) for way in ("auto", "postings", "bitmap")},
        "store_label_values": lambda s, d: kept_store(s, d, "F3", A).label_values("band"),
        "store_label_names": lambda s, d: kept_store(s, d, "F3", A).label_names(),
        "store_postings": store_postings,
    }


_SMP = """smp AS (
  SELECT epoch_us(ts) // 1000 AS t, value AS v, event_type, CAST(user_id AS VARCHAR) AS user_id, props->>'$.k' AS k,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 50 THEN 'low' WHEN value < 150 THEN 'mid' ELSE 'high' END END AS band
  FROM events)"""
_S1 = "s1 AS (SELECT row_number() OVER (ORDER BY event_type, user_id) AS tsid, event_type, user_id, min(t) AS min_t, max(t) AS max_t FROM smp GROUP BY event_type, user_id)"
_S2 = "s2 AS (SELECT row_number() OVER (ORDER BY event_type, user_id, k) AS tsid, event_type, user_id, k FROM (SELECT DISTINCT event_type, user_id, k FROM smp))"
_S3 = "s3 AS (SELECT row_number() OVER (ORDER BY event_type, user_id, band NULLS FIRST) AS tsid, event_type, user_id, band, min(t) AS min_t, max(t) AS max_t FROM smp GROUP BY event_type, user_id, band)"
_X1 = "x1 AS (SELECT s1.tsid, smp.* FROM smp JOIN s1 ON smp.event_type = s1.event_type AND smp.user_id = s1.user_id)"
_P3 = """p3 AS (
  SELECT 'event_type' AS name, event_type AS value, tsid, min_t, max_t FROM s3
  UNION ALL SELECT 'user_id', user_id, tsid, min_t, max_t FROM s3
  UNION ALL SELECT 'band', band, tsid, min_t, max_t FROM s3 WHERE band IS NOT NULL
  UNION ALL SELECT '__name__', 'events_value', tsid, min_t, max_t FROM s3)"""
_BASE = f"WITH {_SMP}, {_S1}, {_S2}, {_S3}, {_X1}, {_P3} "
_LIST = "SELECT tsid FROM p3 WHERE name = '{}' AND value = '{}'"


def oracle_sql() -> dict[str, str]:
    s3 = "SELECT tsid FROM s3 WHERE "
    out = {
        "series_with_labels": f"SELECT tsid, event_type, user_id, t, v FROM x1 WHERE event_type = 'error' AND user_id < '2' AND t BETWEEN {A} AND {B}",
        "match_eq": s3 + "event_type = 'click'",
        "match_neq": s3 + "user_id >= '5' AND band IS DISTINCT FROM 'low'",
        "match_neq_reject_absent": s3 + "user_id >= '5' AND band <> 'low'",
        "match_neq_only": s3 + "event_type <> 'click' AND band <> 'low'",
        "match_lt": s3 + "user_id < '5'",
        "match_gt": s3 + "user_id > '5'",
        "match_lte": s3 + "user_id <= '5'",
        "match_gte": s3 + "user_id >= '5'",
        "match_re": s3 + "regexp_full_match(event_type, 'cl.*|view')",
        "match_nre": s3 + "NOT regexp_full_match(band, 'l.*')",
        "match_and": s3 + "event_type = 'purchase' AND band = 'high' AND user_id < '5'",
        "match_empty": s3 + "1 = 0",
        "resolve_matchers": f"SELECT tsid FROM s1 WHERE event_type = 'click' AND regexp_full_match(user_id, '1.*') AND min_t < {B} AND max_t >= {A}",
        "active_overlap": f"SELECT tsid FROM s1 WHERE min_t < {B} AND max_t >= {A}",
        "active_exact": f"SELECT DISTINCT tsid FROM x1 WHERE t >= {A} AND t < {B}",
        "select_series": f"SELECT tsid, t, v FROM x1 WHERE event_type = 'click' AND user_id IN ('1', '2', '3') AND t BETWEEN {A} AND {B}",
        "series_labels": "SELECT name, value FROM p3 WHERE tsid = 10",
        "series_exists": "SELECT tsid FROM s1 WHERE event_type = 'click' AND user_id = '1'",
        "label_values": "SELECT DISTINCT value FROM p3 WHERE name = 'band'",
        "label_values_all": "SELECT name, value, count(*) AS n FROM p3 GROUP BY name, value",
        "current_tsid": "SELECT max(tsid) + 1 AS next_tsid FROM s1",
        "postings_list": "SELECT name, value, tsid FROM p3 WHERE name IN ('event_type', 'band')",
        "postings_and": f"{_LIST.format('event_type', 'purchase')} INTERSECT {_LIST.format('band', 'high')}",
        "postings_or": f"{_LIST.format('event_type', 'click')} UNION {_LIST.format('band', 'high')}",
        "postings_andnot": f"{_LIST.format('event_type', 'purchase')} EXCEPT {_LIST.format('band', 'low')}",
        "bitmap_cardinality": "SELECT name, value, count(DISTINCT tsid) AS n FROM p3 GROUP BY name, value",
        "bitmap_buckets": "SELECT k, CAST(floor((tsid - 1) / 32768.0) AS BIGINT) + 1 AS bucket, count(DISTINCT tsid) AS n FROM s2 GROUP BY 1, 2",
        "posting_intervals": "SELECT name, value, min(min_t) AS min_t, max(max_t) AS max_t, count(*) AS n FROM p3 GROUP BY name, value",
        "compaction_epochs": f"SELECT tsid, CAST(floor((t - {ORIGIN}) / 604800000.0) AS BIGINT) AS epoch, min(t) AS min_t, max(t) AS max_t FROM x1 GROUP BY 1, 2",
        "hot_cold_union": f"SELECT tsid FROM x1 WHERE event_type = 'click' AND t >= {B} UNION SELECT tsid FROM x1 WHERE event_type = 'click' AND t < {B}",
        "at_version": f"SELECT DISTINCT event_type, user_id FROM smp WHERE t < {A}",
        "add_series_existing": f"SELECT event_type, user_id FROM smp WHERE t >= {A} INTERSECT SELECT event_type, user_id FROM smp WHERE t < {A}",
        "add_series_new": f"SELECT (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM smp WHERE t < {A})) + row_number() OVER (ORDER BY event_type, user_id) AS tsid, event_type, user_id FROM (SELECT event_type, user_id FROM smp WHERE t >= {A} EXCEPT SELECT event_type, user_id FROM smp WHERE t < {A})",
        "append_samples": "SELECT tsid, count(*) AS n, round(sum(v), 2) AS sum_v FROM x1 GROUP BY tsid",
    }
    out |= {
        "bitmap_and": out["postings_and"],
        "bitmap_or": out["postings_or"],
        "layout_choice": "SELECT name, CASE WHEN ceil(count(*) * 12 / 4096.0) * 4096 <= count(DISTINCT value) * 4096 THEN 'list' ELSE 'bitmap' END AS layout FROM p3 GROUP BY name",
        "label_names": "SELECT DISTINCT name FROM p3",
        "postings_cardinality": f"SELECT count(DISTINCT tsid) AS n FROM ({_LIST.format('band', 'high')})",
        "seek_samples": f"SELECT tsid, t, v FROM x1 WHERE event_type = 'signup' AND t >= {B}",
        "series_set": "SELECT tsid, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM x1 GROUP BY tsid",
        "manual_compact": f"SELECT event_type, user_id, t, v FROM x1 WHERE event_type = 'error' AND user_id < '2' AND t BETWEEN {A} AND {B}",
        "recovery": "SELECT event_type, user_id, min_t AS created_t FROM s1",
        "store_at_version": f"SELECT event_type, user_id, t, v FROM x1 WHERE event_type = 'error' AND t < {A}",
        "store_label_values": out["label_values"],
        "store_label_names": "SELECT DISTINCT name FROM p3",
        "store_postings": "SELECT name, value, count(*) AS n FROM p3 WHERE name IN ('event_type', 'band') GROUP BY name, value",
    }
    # A series is active if one of its intervals is: that of the first commit or that of the second.
    iv = " UNION ALL ".join(f"SELECT event_type, user_id, band, min(t) AS lo, max(t) AS hi FROM smp WHERE t {side} {A} GROUP BY event_type, user_id, band" for side in ("<", ">="))
    active = f"SELECT DISTINCT event_type, user_id, band FROM ({iv}) WHERE event_type = 'purchase' AND band IS DISTINCT FROM 'low' AND user_id < '5' AND lo < {B} AND hi >= {A}"
    out |= {f"store_resolve_{way}": active for way in ("map", "postings", "bitmap")} | {f"store_select_{way}": out["manual_compact"] for way in ("auto", "postings", "bitmap")}
    out["stream_ingest"] = out["manual_compact"]
    out |= {f"match_and_{k}": out["match_and"] for k in ("postings", "bitmap")} | {"match_neq_postings": out["match_neq"]}
    return {name: _BASE + sql for name, sql in out.items()}
