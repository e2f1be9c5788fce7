"""Event streams: windows with late data, and duplicates within a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files that arrive in a folder."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_within(events: DataFrame, keys: list[str], ttl: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def kept_within(events: DataFrame, keys: list[str], ttl_seconds: int = 1800) -> DataFrame:
    """The batch twin of first_within: of each key the first event, then the first one a time to live or more after the last kept one.

    Rows of a key are in one task, which holds the last key and time only. Equal times: the smaller event_id.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).repartition(n, *keys).sortWithinPartitions(*keys, "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, 0
        for b in batches:
            keep = []
            for *k, at in zip(*(b.column(c).to_pylist() for c in keys), b.column("at").to_pylist(), strict=True):
                fresh = k != key or at >= until
                if fresh:
                    key, until = k, at + ttl_seconds * 1_000_000
                keep.append(fresh)
            yield b.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema).drop("at")
