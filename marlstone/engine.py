"""The engine: queriers, appenders and label queries over one store."""

from __future__ import annotations

import time
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .model import COMPACT_AFTER, CheckpointPolicy, Matcher, label_set
from .operators import postings as algebra
from .operators import registry, resolve, select, values
from .plans.matchers import compile_matchers
from .plans.selector import parse_selector
from .sources.store import Manifest, Store

Selector = str | Sequence[Matcher]


def _matchers(selector: Selector) -> list[Matcher]:
    return parse_selector(selector) if isinstance(selector, str) else list(selector)


#: Series up to which ``auto`` scans the registry's label maps; beyond, it reads the index.
MAP_SERIES = 50_000
#: Label sets that an engine remembers.
CACHED = 16_384


class Cache(OrderedDict):
    """What was used last, up to ``CACHED`` entries. A series keeps its number and its labels, so only what is not there can change."""

    def recall(self, key, find: Callable[[], object | None]):
        if key in self:
            self.move_to_end(key)
            return self[key]
        found = find()
        if found is not None:
            self[key] = found
            if len(self) > CACHED:
                self.popitem(last=False)
        return found


class Engine:
    """``engine.querier(mint, maxt).select(matchers)`` and ``engine.appender()`` are the usual ways in.

    ``version`` makes an engine that reads that version of the store. ``options`` are the store's:
    ``bitmap_only``, ``background``, ``keep``, ``hot_commits``.
    """

    def __init__(self, spark: SparkSession, path: str, policy: CheckpointPolicy = CheckpointPolicy.NORMAL, compact_after: int = COMPACT_AFTER, neq_absent: str = "pass", version: int | None = None, **options):
        self.spark, self.store, self.neq_absent, self.version = spark, Store(spark, path, policy, compact_after, **options), neq_absent, version
        self.seconds: dict[str, float] = defaultdict(float)
        self._tsids, self._labels = Cache(), Cache()

    def at_version(self, version: int) -> Engine:
        out = Engine(self.spark, self.store.folder.path, self.store.policy, self.store.compact_after, self.neq_absent, version)
        out.store.manifest(version)
        return out

    @contextmanager
    def _timed(self, what: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[what] += time.perf_counter() - began

    def print_stats(self) -> str:
        """Seconds spent so far by each kind of call, also printed."""
        names = ("add_series", "commit", "series_labels", "resolve", "compact")
        out = "\n".join([",".join([*names, "sum"]), ",".join(f"{x:.3f}" for x in [*(self.seconds[n] for n in names), sum(self.seconds.values())])])
        print(out)
        return out

    # Index

    def resolve(self, selector: Selector, start: int | None = None, end: int | None = None, strategy: str = "auto") -> DataFrame:
        """tsid of the series that all matchers pass and that have an interval meeting [start, end).

        ``map`` tests the registry's label maps; ``postings`` and ``bitmap`` read the index of the names that are asked for, as rows or as
        bitmaps, of the epochs in range; ``auto`` takes the first for small registries and the second for others.
        """
        with self._timed("resolve"):
            matchers = _matchers(selector)
            if strategy == "auto":
                strategy = "map" if self.store.manifest(self.version).tsid <= MAP_SERIES else "postings"
            if strategy not in resolve.STRATEGIES:
                raise ValueError(f"strategy is auto or one of {resolve.STRATEGIES}, not {strategy!r}")
            if strategy == "map" or not matchers:
                out = self.store.series(self.version).where(compile_matchers(matchers, lambda n: F.col("labels")[n], self.neq_absent)).select("tsid")
            else:
                out = resolve.by_index(*self.store.index(self.version, start, end), matchers, self.neq_absent, strategy)
            if start is None and end is None:
                return out
            return out.join(self.store.active(self.version, start, end), "tsid", "left_semi")

    def exists(self, labels: Mapping[str, str]) -> int | None:
        """The number of just this label set."""
        known = label_set(labels)

        def find() -> int | None:
            row = self.store.series(self.version, registry.key_of(known)).select("tsid").first()
            return row["tsid"] if row else None

        return self._tsids.recall(tuple(sorted(known.items())), find)

    def series_labels(self, tsid: int) -> dict[str, str] | None:
        def find() -> dict[str, str] | None:
            row = self.store.series(self.version).where(F.col("tsid") == tsid).select("labels").first()
            return dict(row["labels"]) if row else None

        with self._timed("series_labels"):
            found = self._labels.recall(tsid, find)
        return None if found is None else dict(found)

    def label_values(self, name: str) -> DataFrame:
        """The values of a label over the whole registry, without regard to time: the index's rows and bitmaps of that name."""
        rows, maps = self.store.index(self.version)
        return values.label_values(rows.select("name", "value").unionByName(maps.select("name", "value")), name)

    def label_names(self) -> DataFrame:
        rows, maps = self.store.index(self.version)
        return rows.select("name").unionByName(maps.select("name")).distinct()

    def postings(self, name: str, value: str) -> DataFrame:
        rows, maps = self.store.index(self.version)
        asked = (F.col("name") == name) & (F.col("value") == value)
        return algebra.of(rows, name, value).unionByName(algebra.bitmap_tsids(maps.where(asked))).distinct()

    def current_tsid(self) -> int:
        return self.store.manifest(self.version).tsid + 1

    # Samples

    def querier(self, mint: int, maxt: int, strategy: str = "auto") -> Querier:
        return Querier(self, mint, maxt, strategy)

    def appender(self) -> Appender:
        return Appender(self)

    def append(self, batch: DataFrame, batch_id: str | None = None) -> Manifest:
        """A whole DataFrame of (labels, t, v): the way to write much."""
        if self.version is not None:
            raise ValueError("a past version can't be written")
        with self._timed("commit"):
            return self.store.append(batch, batch_id)

    def compact(self) -> Manifest:
        with self._timed("compact"):
            return self.store.compact()

    def wait(self) -> Manifest:
        """Waits for a compaction in the background."""
        return self.store.wait()


class Querier:
    """Selects within [mint, maxt], both ends included; the index is asked for [mint, maxt + 1)."""

    def __init__(self, engine: Engine, mint: int, maxt: int, strategy: str = "auto"):
        self.engine, self.mint, self.maxt, self.strategy = engine, mint, maxt, strategy

    def select(self, selector: Selector) -> DataFrame:
        """tsid, t, v."""
        tsids = self.engine.resolve(selector, self.mint, self.maxt + 1, self.strategy)
        return self.engine.store.samples(self.engine.version, self.mint, self.maxt).join(tsids, "tsid", "left_semi")

    def select_with_labels(self, selector: Selector) -> DataFrame:
        """tsid, t, v, labels, which are joined last."""
        return self.select(selector).join(self.engine.store.series(self.engine.version).select("tsid", "labels"), "tsid")

    def series(self, selector: Selector) -> Iterator[tuple[int, list[Row]]]:
        """Series one by one, each with its samples in order."""
        return select.iterate(self.select(selector))


class Appender:
    """Collects single samples of the caller's and commits them as one batch."""

    def __init__(self, engine: Engine):
        self.engine, self._rows = engine, []

    def add(self, labels: Mapping[str, str], t: int, v: float) -> None:
        with self.engine._timed("add_series"):
            self._rows.append((label_set(labels), int(t), float(v)))

    def commit(self, batch_id: str | None = None) -> Manifest:
        rows, self._rows = self._rows, []
        return self.engine.append(self.engine.spark.createDataFrame(rows, "labels map<string,string>, t long, v double"), batch_id)
