"""A store of series and samples: Parquet folders, and a manifest that says which of them count.

A commit writes its folders first and publishes the next manifest last, which fails
if another writer was first. What no manifest names was never committed: a crash between
the two leaves folders that ``vacuum`` removes, and the registry as it was. Each manifest is a
version that stays readable while it is kept.

*Hot*: each commit writes its samples, and the label sets it touched with their numbers and times, new or not. *Cold*: compaction
folds the hot folders into an epoch: postings, the series' times, and samples by day. Postings are
partitioned by label name and sorted by value, as rows or as bitmaps, whichever the layout rule picks for
the name; a reader skips other names by folder, other values by row group, and epochs outside its time
range altogether. New series go to a registry segment, in folders by a hash of their key, so that a
commit reads the folders that its own keys fall into.

Nothing is rewritten with every compaction: segments and epochs are merged ``FAN`` at a time, those of one level into one of the
next, so that a row is rewritten as often as there are levels, and a manifest names less than ``FAN`` of each level. An
epoch's intervals stay as they are when it is merged: a series is active in a range that one of its intervals
meets, and neither compaction nor merging changes that.
"""

from __future__ import annotations

import json
import sys
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import bucket_of, clean_labels
from ..functions.storage import Folder, settle
from ..model import COMPACT_AFTER, SAMPLES, CheckpointPolicy
from ..operators import registry
from ..operators.activity import overlap
from ..operators.postings import bitmap_pages, layout, postings


class ConflictError(RuntimeError):
    """Another writer published this version first."""


#: Folders of one level that are merged into one; commits after which the hot part is compacted, however few series are new.
FAN, HOT_COMMITS = 8, 32
#: Label sets of a batch that are broadcast to the registry at most; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Versions that compaction leaves, and how old a folder without a version must be for it to remove it.
KEEP, GRACE_MS = 64, 3_600_000


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    #: Appends so far: a manifest with as many differs by compaction only.
    commits: int = 0
    #: The highest number given, and the highest that is compacted.
    tsid: int = 0
    compacted_tsid: int = 0
    #: The latest sample, and the latest that is compacted.
    max_t: int | None = None
    compacted_t: int | None = None
    #: Hot folders: touched series, and samples.
    hot: list[str] = field(default_factory=list)
    #: Registry segments: name and level.
    segments: list[list] = field(default_factory=list)
    #: Epochs: name, level, earliest and latest sample, and the kinds of folders they have.
    epochs: list[list] = field(default_factory=list)
    #: The highest batch number of each stream, and single batch ids.
    streams: dict[str, int] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)

    def folders(self) -> set[str]:
        out = {f"{kind}/{name}" for name in self.hot for kind in HOT}
        out |= {f"series/segment={name}" for name, _ in self.segments}
        return out | {f"{kind}/epoch={name}" for name, _, _, _, kinds in self.epochs for kind in kinds}

    def has(self, batch_id: str) -> bool:
        stream, number = _stream(batch_id)
        return batch_id in self.batches if number is None else self.streams.get(stream, -1) >= number

    def with_batch(self, batch_id: str | None) -> Manifest:
        if batch_id is None:
            return self
        stream, number = _stream(batch_id)
        return replace(self, batches=[*self.batches, batch_id]) if number is None else replace(self, streams=self.streams | {stream: number})


def _stream(batch_id: str) -> tuple[str, int | None]:
    """``name/number`` is a batch of a stream, whose numbers rise; any other id is its own."""
    name, _, number = batch_id.rpartition("/")
    return (name, int(number)) if name and number.isdigit() else (batch_id, None)


HOT = ("touched", "hot_samples")
COLD = ("postings", "bitmaps", "times", "samples")
_TOUCHED = "tsid long, key string, labels map<string,string>, min_t long, max_t long, inserted boolean"
_SEGMENT = "tsid long, key string, labels map<string,string>, created_t long, segment string, bucket int"
_SCHEMAS = {
    "postings": "value string, tsid long, min_t long, max_t long, epoch string, name string",
    "bitmaps": "value string, bucket long, bits binary, min_t long, max_t long, epoch string, name string",
    "times": "tsid long, min_t long, max_t long, epoch string",
    "samples": "tsid long, t long, v double, epoch string, day int",
}
DAY_MS = 86_400_000


def _day(t: Column) -> Column:
    return F.floor(t / F.lit(float(DAY_MS))).cast("int")


class Store:
    """One writer at a time, any number of readers; compaction may run beside the writer.

    ``bitmap_only`` keeps all postings as bitmaps. ``background`` compacts in a thread of its own, as ``wait`` tells.
    """

    def __init__(self, spark: SparkSession, path: str, policy: CheckpointPolicy = CheckpointPolicy.NORMAL, compact_after: int = COMPACT_AFTER, bitmap_only: bool = False, background: bool = False, keep: int = KEEP, hot_commits: int = HOT_COMMITS):
        self.spark, self.folder, self.policy, self.compact_after = spark, Folder(spark, path), policy, compact_after
        self.bitmap_only, self.background, self.keep, self.hot_commits = bitmap_only, background, keep, hot_commits
        self._known: dict[int, Manifest] = {}
        self._thread: threading.Thread | None = None
        self._failed: BaseException | None = None

    # Versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.folder.names("manifest") if n.endswith(".json") and n.startswith("v")]

    def manifest(self, version: int | None = None) -> Manifest:
        """A published manifest never changes, so each is read once."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest()
        if version not in self._known:
            name = f"manifest/v{version:08d}.json"
            if version not in self.versions():
                raise KeyError(f"no version {version}")
            while len(self._known) >= self.keep:
                self._known.pop(next(iter(self._known)), None)
            self._known[version] = Manifest(**json.loads(self.folder.read(name)))
        return self._known[version]

    def _publish(self, m: Manifest) -> Manifest:
        name = f"manifest/v{m.version:08d}.json"
        if not self.folder.publish(name, json.dumps(asdict(m)), f"manifest/.{uuid.uuid4().hex}"):
            raise ConflictError(name)
        return m

    def _publish_on(self, base: Manifest, change: Callable[[Manifest], Manifest], same: Callable[[Manifest], object]) -> Manifest:
        """Publishes ``change`` of the latest manifest, as long as what it rests on is the same there as in ``base``."""
        while True:
            try:
                return self._publish(change(base))
            except ConflictError:
                latest = self.manifest()
                if same(latest) != same(base) or latest.version == base.version:
                    raise
                base = latest

    # Reading

    def _read(self, names: list[str], schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{n}" for n in names])

    def _based(self, kind: str, names: list[str], schema: str) -> DataFrame:
        """One scan of folders under ``kind`` that are each partitioned by a further column."""
        if not names:
            return self.spark.createDataFrame([], schema)
        root = f"{self.folder.path}/{kind}"
        return self.spark.read.option("basePath", root).schema(schema).parquet(*[f"{root}/{n}" for n in names])

    def epochs(self, m: Manifest, kind: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """The cold rows of a kind, of the epochs whose times meet [start, end)."""
        some = [e[0] for e in m.epochs if kind in e[4] and (end is None or e[2] < end) and (start is None or e[3] >= start)]
        return self._based(kind, [f"epoch={e}" for e in some], _SCHEMAS[kind])

    def touched(self, m: Manifest) -> DataFrame:
        """The label sets of each hot commit, with their numbers and times there."""
        return self._read([f"touched/{n}" for n in m.hot], _TOUCHED)

    def _cold_series(self, m: Manifest) -> DataFrame:
        return self._based("series", [f"segment={n}" for n, _ in m.segments], _SEGMENT)

    def series(self, version: int | None = None, key: Column | None = None) -> DataFrame:
        """tsid, key, labels, created_t: the registry, hot and cold. With ``key``, a constant, only the folder that it falls into is read."""
        m = self.manifest(version)
        cold, hot = self._cold_series(m), self.touched(m).where("inserted")
        if key is not None:
            cold, hot = cold.where((F.col("bucket") == bucket_of(key)) & (F.col("key") == key)), hot.where(F.col("key") == key)
        return cold.select("tsid", "key", "labels", "created_t").unionByName(hot.select("tsid", "key", "labels", F.col("min_t").alias("created_t")))

    def samples(self, version: int | None = None, mint: int | None = None, maxt: int | None = None) -> DataFrame:
        """tsid, t, v with mint <= t <= maxt, as far as they are given; other epochs' and other days' folders aren't read."""
        m = self.manifest(version)
        hot, cold = self._read([f"hot_samples/{n}" for n in m.hot], SAMPLES), self.epochs(m, "samples", mint, None if maxt is None else maxt + 1)
        if mint is not None:
            hot, cold = hot.where(F.col("t") >= mint), cold.where((F.col("day") >= mint // DAY_MS) & (F.col("t") >= mint))
        if maxt is not None:
            hot, cold = hot.where(F.col("t") <= maxt), cold.where((F.col("day") <= maxt // DAY_MS) & (F.col("t") <= maxt))
        return cold.select("tsid", "t", "v").unionByName(hot)

    def active(self, version: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """tsid of the series with an interval that meets [start, end), one or more times."""
        m = self.manifest(version)
        rows = self.epochs(m, "times", start, end).select("tsid", "min_t", "max_t").unionByName(self.touched(m).select("tsid", "min_t", "max_t"))
        return rows.where(overlap(start, end)).select("tsid")

    def index(self, version: int | None = None, start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(name, value, tsid, min_t, max_t) rows, hot ones among them, and (name, value, bucket, bits, min_t, max_t) bitmaps: each posting is in the one or the other. Those that can't meet [start, end) are left out."""
        m = self.manifest(version)
        rows = self.epochs(m, "postings", start, end).select("name", "value", "tsid", "min_t", "max_t").unionByName(postings(self.touched(m)))
        maps = self.epochs(m, "bitmaps", start, end).select("name", "value", "bucket", "bits", "min_t", "max_t")
        return rows.where(overlap(start, end)), maps.where(overlap(start, end))

    # Writing

    def append(self, batch: DataFrame, batch_id: str | None = None) -> Manifest:
        """Registers the label sets of ``batch`` (labels, t, v) that are new, and keeps its samples. A batch id counts once.

        A label without a value isn't there; a row without a label set or without a time is refused, with its whole batch.
        """
        self._raise()
        m = self.manifest()
        if batch_id is not None and m.has(batch_id):
            return m
        batch = settle(registry.keyed(batch.select(clean_labels(F.col("labels")).alias("labels"), "t", "v")))
        n, last_t, bad = batch.agg(F.count("*"), F.max("t"), F.count_if(F.col("labels").isNull() | F.col("t").isNull())).first()
        if bad:
            raise ValueError(f"{bad} rows of {n} have no label set or no time")
        if not n:
            return m
        sets = settle(registry.label_sets(batch).withColumn("bucket", bucket_of(F.col("key"))))
        n_sets, buckets = sets.count(), [r["bucket"] for r in sets.select("bucket").distinct().collect()]
        known = self._cold_series(m).where(F.col("bucket").isin(buckets)).select("tsid", "key").unionByName(self.touched(m).where("inserted").select("tsid", "key"))
        asked = sets.select("key")
        old = settle(known.join(F.broadcast(asked) if n_sets <= BROADCAST_KEYS else asked, "key").select("tsid", "key"))
        fresh = registry.number(sets.join(old, "key", "left_anti"), (), m.tsid).select("tsid", "key", "labels", "min_t", "max_t", F.lit(True).alias("inserted"))
        again = sets.join(old, "key").select("tsid", "key", "labels", "min_t", "max_t", F.lit(False).alias("inserted"))
        name = uuid.uuid4().hex
        touched, rows = (f"{self.folder.path}/{kind}/{name}" for kind in HOT)
        again.unionByName(fresh).write.parquet(touched)
        ids = self._read([f"touched/{name}"], _TOUCHED)
        n_new = n_sets - old.count()
        batch.join(ids.select("tsid", "key"), "key").select("tsid", "t", "v").write.parquet(rows)

        def change(on: Manifest) -> Manifest:
            latest = max(x for x in (on.max_t, last_t) if x is not None)
            return replace(on, version=on.version + 1, commits=on.commits + 1, tsid=on.tsid + n_new, max_t=latest, hot=[*on.hot, name]).with_batch(batch_id)

        m = self._publish_on(m, change, lambda x: x.commits)
        if self.policy is not CheckpointPolicy.DISABLED and (m.tsid >= m.compacted_tsid + self.compact_after or len(m.hot) >= self.hot_commits):
            m = self._start() or self.compact() if self.background else self.compact()
        return m

    def _start(self) -> Manifest | None:
        if self._thread is None or not self._thread.is_alive():

            def run() -> None:
                try:
                    self.compact()
                except BaseException as e:  # noqa: BLE001  raised again where it is waited for
                    self._failed = e

            self._thread = threading.Thread(target=run, name="compaction")
            self._thread.start()
        return self.manifest()

    def wait(self) -> Manifest:
        """Waits for a compaction in the background and raises what it raised."""
        if self._thread is not None:
            self._thread.join()
        self._raise()
        return self.manifest()

    def _raise(self) -> None:
        failed, self._failed = self._failed, None
        if failed is not None:
            raise failed

    def _write(self, kind: str, name: str, rows: DataFrame, order: list[str], by: str | None) -> None:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # By the whole order, so that a name or a day with most rows isn't one task's.
        out = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write
        (out.partitionBy(by) if by else out).parquet(f"{self.folder.path}/{kind}/{name}")

    def compact(self) -> Manifest:
        """Folds the hot part into the cold part; readers see the one or the other, never neither. Appends may go on meanwhile."""
        m = self.manifest()
        if not m.hot:
            return m
        if self.policy is CheckpointPolicy.PRINT:
            print(f"{m.tsid + 1},b", file=sys.stderr)
        name = uuid.uuid4().hex
        touched = self.touched(m)
        seen = settle(touched.groupBy("tsid").agg(F.any_value("labels").alias("labels"), F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t")))
        min_t, max_t = seen.agg(F.min("min_t"), F.max("max_t")).first()
        listed = settle(postings(seen))
        ways = {r["name"]: "bitmap" if self.bitmap_only else r["layout"] for r in layout(listed).collect()}  # a row for each label name
        as_bitmaps = F.col("name").isin([n for n, way in ways.items() if way == "bitmap"])
        kinds = ["times", "samples"]
        self._write("times", f"epoch={name}", seen.select("tsid", "min_t", "max_t"), ["tsid"], None)
        if "list" in ways.values():
            self._write("postings", f"epoch={name}", listed.where(~as_bitmaps).select("name", "value", "tsid", "min_t", "max_t"), ["name", "value", "tsid"], "name")
            kinds.append("postings")
        if "bitmap" in ways.values():
            self._write("bitmaps", f"epoch={name}", bitmap_pages(listed.where(as_bitmaps)), ["name", "value", "bucket"], "name")
            kinds.append("bitmaps")
        daily = self._read([f"hot_samples/{n}" for n in m.hot], SAMPLES).withColumn("day", _day(F.col("t")))
        self._write("samples", f"epoch={name}", daily, ["day", "tsid", "t"], "day")
        epochs = self._merged_epochs([*m.epochs, [name, 0, min_t, max_t, kinds]])
        segments = m.segments
        if m.tsid > m.compacted_tsid:
            fresh = touched.where("inserted").select("tsid", "key", "labels", F.col("min_t").alias("created_t"))
            self._write_segment(name, fresh)
            segments = self._merged_segments([*segments, [name, 0]])
        gone = set(m.hot)

        def change(on: Manifest) -> Manifest:
            return replace(on, version=on.version + 1, compacted_tsid=m.tsid, compacted_t=m.max_t, hot=[h for h in on.hot if h not in gone], segments=segments, epochs=epochs)

        m = self._publish_on(m, change, lambda x: [e[0] for e in x.epochs])
        if self.policy is CheckpointPolicy.PRINT:
            print(f"{m.tsid + 1},e", file=sys.stderr)
        self.vacuum(self.keep, GRACE_MS)
        return m

    def _write_segment(self, name: str, rows: DataFrame) -> None:
        self._write("series", f"segment={name}", rows.withColumn("bucket", bucket_of(F.col("key"))), ["bucket", "tsid"], "bucket")

    def _merged_segments(self, segments: list[list]) -> list[list]:
        for level, some in iter(lambda: _full(segments), None):
            name = uuid.uuid4().hex
            self._write_segment(name, self._based("series", [f"segment={s[0]}" for s in some], _SEGMENT).select("tsid", "key", "labels", "created_t"))
            segments = [[name, level + 1], *[s for s in segments if s not in some]]
        return segments

    def _merged_epochs(self, epochs: list[list]) -> list[list]:
        order = {"postings": (["name", "value", "tsid"], "name"), "bitmaps": (["name", "value", "bucket"], "name"), "times": (["tsid"], None), "samples": (["day", "tsid", "t"], "day")}
        for level, some in iter(lambda: _full(epochs), None):
            name, kinds = uuid.uuid4().hex, [k for k in COLD if any(k in e[4] for e in some)]
            for kind in kinds:
                rows = self._based(kind, [f"epoch={e[0]}" for e in some if kind in e[4]], _SCHEMAS[kind]).drop("epoch")
                self._write(kind, f"epoch={name}", rows, *order[kind])
            epochs = [[name, level + 1, min(e[2] for e in some), max(e[3] for e in some), kinds], *[e for e in epochs if e not in some]]
        return epochs

    def vacuum(self, keep: int = 1, grace_ms: int = 0) -> list[str]:
        """Removes manifests but the last ``keep``, and all folders that none of those names, unless they are younger than ``grace_ms``: a writer may be about to name them. Gives what went."""
        known = self.versions()
        kept = known[-keep:] if keep else []
        used = {f for v in kept for f in self.manifest(v).folders()}
        gone = [f"manifest/{n}" for n in self.folder.names("manifest", grace_ms if grace_ms else None) if n not in {f"v{v:08d}.json" for v in kept} and not n.endswith(".crc") and (not grace_ms or n.startswith("v"))]
        if grace_ms:
            gone += [f"manifest/v{v:08d}.json" for v in known[: -keep or None] if f"manifest/v{v:08d}.json" not in gone]
        gone += [f"{kind}/{n}" for kind in (*HOT, "series", *COLD) for n in self.folder.names(kind, grace_ms) if f"{kind}/{n}" not in used]
        for name in gone:
            self.folder.remove(name)
            if name.startswith("manifest/v"):
                self._known.pop(int(name[10:18]), None)
        return gone


def _full(things: list[list]) -> tuple[int, list[list]] | None:
    """A level with ``FAN`` folders or more, and the folders."""
    for level in sorted({x[1] for x in things}):
        some = [x for x in things if x[1] == level]
        if len(some) >= FAN:
            return level, some
    return None
