"""Where stored indexes live: a folder that driver and executors share, one index for each state of its source."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may do without, and gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='docatlas-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def state(spark: SparkSession, path: str) -> str:
    """A digest of a file's or folder's files, their lengths and times: another state has another digest."""
    fs, at = filesystem(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def once(spark: SparkSession, kind: str, source: str, build: Callable[[str], None]) -> str:
    """The folder of an index of a source, built if its present state has none yet.

    It is built beside and moved into place whole, so that a reader never meets a part; of two that build at once the first
    to finish is kept.
    """
    target = f"{shared(spark)}/{kind}-{state(spark, source)}"
    fs, at = filesystem(spark, target)
    if not fs.exists(at):
        making = f"{target}-{uuid.uuid4().hex}"
        build(making)
        _, made = filesystem(spark, making)
        with contextlib.suppress(Exception):  # the other one came first
            fs.rename(made, at)
        stray = spark._jvm.org.apache.hadoop.fs.Path(at, made.getName())  # where a rename to a folder that is there puts it
        for rest in (stray, made):
            if fs.exists(rest):
                fs.delete(rest, True)
    return target
