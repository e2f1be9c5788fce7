"""What the operators of this subpackage share: the shared folder, written intermediate tables, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a Python worker gets at once; they bound its memory where texts are long.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get; a smaller bound that the caller has set stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a local session may do without: it gets one of its own."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='docatlas-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors. A task writes a file, so that writing never narrows the work."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: What operators keep in a Python worker between tasks: how to drop it, by operator.
_kept: dict[str, Callable[[], None]] = {}


def keeping(name: str, drop: Callable[[], None] | None = None) -> None:
    """Called in a worker by an operator: drops what others keep there and gives the memory back, as workers outlive stages."""
    others = [k for k in _kept if k != name]
    for k in others:
        _kept.pop(k)()
    if drop:
        _kept[name] = drop
    if others:
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Intermediate tables of an operator; those that its result does not read are deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        deleted(self.spark, self.paths)

    def written(self, df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
        path = fresh_path(self.spark, tag)
        self.paths.append(path)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self, tag: str) -> None:
        """Deletes the tables of a tag before the block ends."""
        gone = [p for p in self.paths if p.rsplit("/", 1)[-1].startswith(f"{tag}-")]
        deleted(self.spark, gone)
        self.paths = [p for p in self.paths if p not in gone]


def free(name: str, columns: list[str]) -> str:
    """name, or with underscores put before it one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, tag: str = "cc", rounds: int = 40) -> DataFrame:
    """Edges (a, b) of longs to (node, label): label is the smallest node of its component.

    Alternates large-star and small-star steps. A step re-hangs edges and emits at most two rows an edge, so
    that a hub costs no more than its degree; each step is written, the one before it deleted, and the counts that
    end the loop are two longs.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, seen = fresh_path(spark, tag), None
    e.write.parquet(path)
    for _ in range(rounds):
        e = spark.read.schema("a long, b long").parquet(path)
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*")
        last, path = path, fresh_path(spark, tag)
        small.where("a <> b").distinct().write.parquet(path)
        deleted(spark, [last])
        e = spark.read.schema("a long, b long").parquet(path)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
