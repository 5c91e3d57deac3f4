"""Executors that can't import the package."""

import os
import subprocess
import sys

import pytest

CODE = """
import sys
sys.path.insert(0, {repo!r})
import os
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()


def can_import(_):
    try:
        import marlstone  # noqa: F401
        return [1]
    except ImportError:
        return [0]


assert spark.sparkContext.parallelize([0], 1).mapPartitions(can_import).collect() == [0]
from marlstone.llm import {module} as op

docs = spark.createDataFrame([(k, "write to jo.lu [at] mail [dot] com about " + ("ugly words here " if k % 2 else "fine texts today ") * 3) for k in range(20)], "doc_id long, text string")
labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, y int")
items = spark.createDataFrame([(1, "about ugly words here")], "item_id long, text string")
print("ROWS", ({call}).count())
"""
CALLS = {
    "fm_decontam": "op.find(docs, items)",
    "pii_boost": "op.find(docs).where('n_added > 0')",
    "nb_toxic": "op.score(docs, op.train(docs, labels, 'y'))",
    "mil_quality": "op.score(docs, op.train(docs, labels, 'y'))",
    "simhash": "op.near_dups(docs)",
    "exthash": "op.dedup(docs)",
    "jaccard": "docs.join(op.keep_one(docs).select('doc_id'), 'doc_id', 'full')",
}


@pytest.mark.parametrize("module", list(CALLS))
def test_workers_without_the_package(module, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(repo=repo, shared=str(tmp_path / "shared"), module=module, call=CALLS[module])
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 20" in done.stdout, done.stderr[-1500:]


def test_no_local_folder_on_clusters(spark, monkeypatch):
    """Where the master isn't local, the shared folder must be named."""
    from marlstone.functions import storage
    from marlstone.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Dir:
        def isDefined(self):
            return False

    class Fake:
        conf, master = Conf(), "spark://host:7077"
        sparkContext = property(lambda self: self)
        _jsc = property(lambda self: self)
        sc = lambda self: self
        getCheckpointDir = lambda self: Dir()

    for of in (common.shared_dir, storage.shared_dir):
        with pytest.raises(RuntimeError):
            of(Fake())
