"""Texts that arrive in a folder, as sentences that are handed on as soon as they are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.functions import text as T


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ordinal, sentence) of text files as they come in; a file is read once."""
    raw = spark.readStream.schema("value string").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.posexplode(T.sentences(F.col("value"))).alias("ordinal", "sentence"))


def handed(rows: DataFrame, checkpoint: str, ready: Callable[[DataFrame, int], None], once: bool = True):
    """Starts a query that calls ready(batch, number) for each batch. A batch may come again after a failure, with the same number."""
    out = rows.writeStream.foreachBatch(ready).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
