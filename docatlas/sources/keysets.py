"""A table copied by ranges of its key, each on its own: what is done is not read again, what cannot be read is told.

Ranges are cut from the distribution of the key, so that each holds about as many rows. Each is written as one folder, in place
only when it is whole, which is all the progress there is to remember: a copy that was stopped goes on with the ranges that
lack a folder, and a range that a lost task began twice is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.indexes.home import filesystem


def ranges(df: DataFrame, key: str, n: int, accuracy: int = 10_000) -> list[tuple[object, object]]:
    """Up to n ranges (after, to) of a key that hold about as many rows each; the first begins before all keys, the last ends after all. A frequent key is in one range."""
    at = [i / n for i in range(1, n)]
    cuts = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, at, accuracy)).first()[0] if at else []
    edges = sorted(set(cuts or []))
    return list(zip([None, *edges], [*edges, None], strict=True))


def between(key: str, after: object, to: object) -> Column:
    """Rows of a range; the last one takes rows without a key as well."""
    c = F.col(key)
    low = c > F.lit(after) if after is not None else F.lit(True)
    return low & (c <= F.lit(to)) if to is not None else F.coalesce(low, F.lit(True)) | c.isNull() if after is None else low | c.isNull()


def cells(df: DataFrame, schema: str) -> tuple[DataFrame, Column]:
    """A table of texts cast cell by cell: one that cannot be read is null. Also how many of a row's cells were there and could not."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    raw = [F.col(f.name).cast("string") for f in wanted]
    cast = [c.try_cast(f.dataType).alias(f.name) for c, f in zip(raw, wanted, strict=True)]
    lost = sum((F.when(c.isNotNull() & x.isNull(), 1).otherwise(0) for c, x in zip(raw, (c.try_cast(f.dataType) for c, f in zip(raw, wanted, strict=True)), strict=True)), F.lit(0))
    return df.select(*cast, lost.alias("_lost"), F.to_json(F.struct(*(F.col(f.name) for f in wanted))).alias("_row")), F.col("_lost")


def copied(spark: SparkSession, read: Callable[[Column], DataFrame], key: str, schema: str, parts: list[tuple[object, object]], path: str, must: list[str] = ()) -> list[int]:
    """Copies the ranges that are not there yet, and tells which those were.

    read gives the source's rows under a condition, which a database or a file scan takes as its own. A cell that is not of
    its type becomes null; a row without a column of `must`, such as the key, goes to the rejects with what it said.
    """
    fs, at = filesystem(spark, path)
    done = []
    for i, (after, to) in enumerate(parts):
        target, draft = spark._jvm.org.apache.hadoop.fs.Path(at, f"range={i}"), spark._jvm.org.apache.hadoop.fs.Path(at, f"_draft-{i}")
        if fs.exists(target):
            continue
        fs.delete(draft, True)
        rows, _ = cells(read(between(key, after, to)), schema)
        bad = F.lit(False)
        for c in must:
            bad |= F.col(c).isNull()
        rows.withColumn("_bad", bad).write.parquet(draft.toString())
        if not fs.rename(draft, target):
            raise OSError(f"{draft} could not be moved")
        done.append(i)
    return done


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was copied and is sound."""
    return _all(spark, path, schema).where("not _bad").drop("_bad", "_lost", "_row", "range")


def rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(row, cells): rows that were not taken, and rows of which cells were lost, as they were said."""
    return _all(spark, path, schema).where("_bad or _lost > 0").select(F.col("_row").alias("row"), F.col("_lost").alias("cells"), F.col("_bad").alias("left_out"))


def _all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _lost int, _row string, _bad boolean, range int").parquet(path)
