"""Folders on the session's file systems, and intermediate tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Schemes of object stores, where a rename is a copy.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cosn")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a new local one, if the master is local; else an error."""
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="marlstone-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; what follows reads the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """A folder of any file system that Spark reads: text files with atomic publication, listing, removal."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "", older_ms: int | None = None) -> list[str]:
        """What is in a folder; with ``older_ms``, what was last changed longer ago than that."""
        at = self._at(name)
        if not self._fs.exists(at):
            return []
        before = None if older_ms is None else time.time() * 1000 - older_ms
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if before is None or s.getModificationTime() <= before)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str, scratch: str) -> bool:
        """Puts a whole file in place at once; false if one of that name is there already, however many try together.

        On local disks by a hard link, which fails if the name is taken. On object stores by a create that refuses to
        overwrite: an object appears whole when it is closed. Elsewhere by a rename, which doesn't overwrite on HDFS.
        """
        scheme = self._fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            return self._create(name, text)
        stream = self._fs.create(self._at(scratch), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if scheme == "file":
                files, here = self._jvm.java.nio.file.Files, self._jvm.java.io.File
                files.createLink(here(self._at(name).toUri().getPath()).toPath(), here(self._at(scratch).toUri().getPath()).toPath())
                return True
            return not self._fs.exists(self._at(name)) and self._fs.rename(self._at(scratch), self._at(name))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(self._at(scratch), False)

    def _create(self, name: str, text: str) -> bool:
        try:
            stream = self._fs.create(self._at(name), False)
            stream.write(bytearray(text.encode()))
            stream.close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception) and "PreconditionFailed" not in str(e.java_exception) and "412" not in str(e.java_exception):
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
