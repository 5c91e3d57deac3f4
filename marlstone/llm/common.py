"""What the training-data operators share: column choice, shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Functions of this subpackage travel to executors by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def place(df: DataFrame, name: str) -> int:
    """The position of a column: by exact name first, then without regard to case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        if (at := next((i for i, c in enumerate(df.columns) if same(c)), None)) is not None:
            return at
    raise ValueError(f"no column {name!r} among {df.columns}")


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... so that further columns whose names clash do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns c0, c1, ... of ``df`` under ``names``."""
    return df.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only the named columns, as ``alias="column"``."""
    return by_place(df).select(*[F.col(f"c{place(df, name)}").alias(alias) for alias, name in columns.items()])


def row_digest(df: DataFrame) -> Column:
    """A digest of all of a row's columns, nulls among them: an order of rows that is the same whenever they are made again."""
    return F.xxhash64(*[x for f in df.schema.fields for x in ((F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name)), F.col(f.name).isNull())])


def null_safe(key: Column) -> list[Column]:
    """Two columns that are equal for equal keys, null among them: some_id and no_id."""
    return [F.coalesce(key.cast("long"), F.lit(0)).alias("some_id"), key.isNull().alias("no_id")]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a new local one, if the master is local; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        path = tempfile.mkdtemp(prefix="marlstone-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: later steps read the files, not the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: list[tuple[SparkSession, str]] = []


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet files in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(*used: DataFrame) -> None:
    """Removes the files of what ``settle`` or ``shared_table`` gave, once all that was made of it is settled itself."""
    for df in used:
        spark, path = df.sparkSession, getattr(df, "shared_path", None)
        if path is None:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            path = file.get() if file.isDefined() else None
        if path is not None:
            _remove(spark, path)
            _TABLES[:] = [x for x in _TABLES if x[1] != path]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_shared_tables() -> None:
    """Removes the tables that ``shared_table`` has written in this process; DataFrames on them can't be read any more."""
    while _TABLES:
        spark, path = _TABLES.pop()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        drop_shared_tables()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(slot: str, key: object, build: Callable[[], object]) -> object:
    """An object built once in each Python worker and kept from task to task; a slot keeps the one of its latest key."""
    module = sys.modules.setdefault("_marlstone_worker_state", types.ModuleType("_marlstone_worker_state"))
    kept = module.__dict__.setdefault("kept", {})
    if kept.get(slot, (None,))[0] != key:
        kept.pop(slot, None)
        kept[slot] = (key, build())
    return kept[slot][1]


class Shared:
    """A value for executors: pickled with its classes, so that they need no copy of this package; unpickled once in each worker."""

    def __init__(self, spark: SparkSession, value: object):
        self.slot, self.key = type(value).__name__, uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __call__(self) -> object:
        return worker_state(self.slot, self.key, lambda: pickle.loads(self.sent.value))


#: A-Z to a-z, all else as it is; safe on UTF-8, whose other bytes are 0x80 and up.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``size`` bytes, or one row, so that a task's arrays stay small."""
    for batch in batches:
        left = [batch]
        while left:
            b = left.pop()
            if b.num_rows > rows:
                left += [b.slice(rows), b.slice(0, rows)]
            elif b.nbytes > size and b.num_rows > 1:
                left += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            elif b.num_rows:
                yield b
