"""A stored trigram index: substring and similarity searches read the few rows that can match, and test those exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders, rows of a part, trigrams of a needle that are looked up at most (the rarest), and entries of a piece of a part.
FOLDERS, PART, LOOKED_UP, PIECE = 16, 4096, 6, 4_000_000
SCHEMAS = {"lists": "gram string, part int, piece int, rows long, ids array<long>, folder int", "counts": "gram string, rows long, folder int"}


def folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def word_grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case with two blanks before and one after it, as similarity counts them."""
    return grams(F.concat(F.lit("  "), text, F.lit(" ")))


def build(rows: DataFrame, path: str) -> None:
    """rows (id, value) to an index at path: for each trigram of a padded value the ids that hold it, in parts, and the values themselves.

    A part's lists are gathered within one task, a piece at a time, so that no trigram is ever gathered over parts. Null
    values are kept but hold nothing; of rows that share an id all values count.
    """
    parts = max(1, -(-rows.count() // PART))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    rows.select(part, F.col("id").cast("long"), "value").repartition(parts, "part").sortWithinPartitions("part", "id").write.parquet(f"{path}/values")
    spark, most = rows.sparkSession, PIECE
    held = spark.read.schema("part int, id long, value string").parquet(f"{path}/values").where("value is not null and id is not null").repartition(parts, "part").sortWithinPartitions("part", "id")
    padded = F.concat(F.lit("  "), F.lower("value"), F.lit(" ")).alias("value")
    lists = held.select("part", "id", padded).mapInArrow(lambda batches: gathered(batches, most), SCHEMAS["lists"].rpartition(",")[0]).withColumn("folder", folder(F.col("gram")))
    lists.sortWithinPartitions("folder", "gram", "part").write.partitionBy("folder").option("parquet.writer.version", "v2").option("parquet.block.size", 16 << 20).parquet(f"{path}/lists")
    counts = spark.read.schema(SCHEMAS["lists"]).parquet(f"{path}/lists").groupBy("folder", "gram").agg(F.sum("rows").alias("rows"))
    counts.repartition(FOLDERS, "folder").sortWithinPartitions("gram").write.partitionBy("folder").parquet(f"{path}/counts")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Padded values (part, id, value) in that order to lists of ids, one for each trigram and piece: a part, or what of it has about `most` entries, cut between ids."""
    held, ids, size, piece, last = [], [], 0, 0, (None, None)
    for b in batches:
        for part, i, value in zip(b["part"].to_pylist(), b["id"].to_pylist(), b["value"].to_pylist(), strict=True):
            if held and (part != last[0] or (size >= most and i != last[1])):
                yield _lists(last[0], piece, held, ids)
                held, ids, size, piece = [], [], 0, 0 if part != last[0] else piece + 1
            c = np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.int64)
            held.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
            ids.append(i)
            size, last = size + len(held[-1]), (part, i)
    if held:
        yield _lists(last[0], piece, held, ids)


def _lists(part: int, piece: int, held: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
    keys, of = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(x) for x in held])
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    once = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])][: len(keys)]
    keys, of = keys[once], of[once]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    low, code = (1 << 21) - 1, keys[first]
    said = np.stack([code >> 42, code >> 21 & low, code & low], 1).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.r_[first, len(keys)]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(of))
    n = len(first)
    return pa.RecordBatch.from_arrays([pa.array([said[3 * i : 3 * i + 3] for i in range(n)], pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, piece, np.int32)), pa.array(np.diff(ends)), lists], ["gram", "part", "piece", "rows", "ids"])


@dataclass
class Trigrams:
    spark: SparkSession
    path: str

    @property
    def values(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/values")

    def _of(self, name: str, some: list[str]) -> DataFrame:
        at = [r[0] for r in self.spark.createDataFrame([(g,) for g in some], "gram string").select(folder(F.col("gram"))).distinct().collect()]
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}").where(F.col("folder").isin(at) & F.col("gram").isin(some))

    def candidates(self, needle: str) -> DataFrame | None:
        """(part, id): rows that hold the rarest trigrams of a needle, or None where it is too short or a pattern too broad to tell.

        % and _ stand for any characters, as in LIKE; only the literal stretches between them are looked up.
        """
        found = sorted({s[i : i + 3] for s in re.split("[%_]", needle.lower()) for i in range(len(s) - 2)})
        if not found:
            return None
        rows = {r.gram: r.rows for r in self._of("counts", found).select("gram", "rows").collect()}
        if len(rows) < len(found):  # a trigram that no row holds
            return self.spark.createDataFrame([], "part int, id long")
        rare = sorted(found, key=lambda g: (rows[g], g))[:LOOKED_UP]
        lists = self._of("lists", rare).groupBy("part", "piece").agg(F.collect_list("ids").alias("all")).where(F.size("all") == len(rare))
        both = F.aggregate(F.slice("all", 2, LOOKED_UP), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return lists.select("part", F.explode(both).alias("id"))

    def containing(self, needle: str) -> DataFrame:
        """(id, value) of the rows whose value holds the needle, whatever its case; the same rows as a scan gives."""
        some = self.candidates(needle)
        rows = self.values if some is None else self.values.join(some, ["part", "id"], "left_semi")
        return rows.where(F.col("value").ilike(f"%{needle}%")).select("id", "value")

    def similar(self, text: str, least: float = 0.3) -> DataFrame:
        """(id, value, similarity) of the rows whose trigrams and those of text overlap by `least` at least: common ones by all.

        A row that shares fewer than `least` of the text's trigrams cannot reach it; only the others are tested.
        """
        padded = f"  {text.lower()} "
        own = sorted({padded[i : i + 3] for i in range(len(padded) - 2)})
        shared = self._of("lists", own).select("part", F.explode("ids").alias("id")).groupBy("part", "id").count().where(F.col("count") >= least * len(own))
        mine = F.array(*map(F.lit, own))
        rows = self.values.join(shared, ["part", "id"], "left_semi").withColumn("g", word_grams(F.col("value")))
        both = F.size(F.array_intersect("g", mine))
        return rows.withColumn("similarity", both / (F.size("g") + len(own) - both)).where(F.col("similarity") >= least).select("id", "value", "similarity")
