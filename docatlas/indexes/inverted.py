"""A stored inverted index over chunks: look-ups and searches read the postings of their words, never the texts.

A part holds the documents of one hash. Its postings are gathered within one task, a row a word with what tells whether the
part can be among the best, and lie in folders by a hash of their word and, within, in order of word and part. So a query opens
the folders of its words and, by the statistics of pages, little else of them, and parts that cannot be among the best are told
by the small columns alone. No list of a word is ever gathered over parts. Positions are kept as gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents of a part, folders, parts that a task gathers, parts for which a folder of words gets another file, and words after which a row of a part is closed.
PART, FOLDERS, GATHERED, LEXICON, WORDS = 2048, 16, 2, 64, 4_000_000
#: Parts that are searched first for a bound, postings up to which a search reads all parts at once, and parts that a filter may list.
FIRST, PLAIN, LISTED = 16, 2_000_000, 5_000
#: The weight of repeated words and of a chunk's length.
K1, B = 1.2, 0.75


def folder(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FOLDERS)).cast("int")


def words_of(chunk: Column) -> Column:
    """Runs of letters in lower case; what stands before the first or after the last may leave empty ones."""
    return F.split(F.lower(chunk), r"[^\p{L}]+")


def build(chunks: DataFrame, path: str, docs: int | None = None) -> None:
    """chunks (doc_id, ordinal, chunk, and words unless words_of tells them) to an index at path; docs, if known, is about how many documents there are.

    Null chunks and empty words have no postings; a chunk that comes twice counts once.
    """
    spark = chunks.sparkSession
    docs = chunks.select("doc_id").distinct().count() if docs is None else docs
    parts = max(1, -(-docs // PART))
    tasks = -(-parts // GATHERED)
    held = [c for c in ("chunk", "words") if c in chunks.columns]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")
    rows = chunks.select(part, F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").cast("int").alias("ordinal"), F.struct(*held).alias("c")).withColumn("task", F.col("part") % tasks).repartitionById(tasks, "task")
    said = F.filter(F.col("words") if "words" in held else words_of(F.col("chunk")), lambda w: w != "")
    one = rows.groupBy("task", "part", "doc_id", "ordinal").agg(F.max("c").alias("c")).select("task", "part", "doc_id", "ordinal", "c.*")
    length = F.size(said) if "words" in held else F.regexp_count(F.lower("chunk"), F.lit(r"\p{L}+"))
    one.withColumn("length", F.coalesce(length, F.lit(0)).cast("int")).sortWithinPartitions("task", "part", "doc_id", "ordinal").drop("task").write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{path}/chunks")
    whole = spark.read.parquet(f"{path}/chunks")
    n, mean, docs = whole.agg(F.count("*"), F.avg("length"), F.countDistinct("doc_id")).first()
    mean = float(mean or 1.0)
    dealt = whole.select("part", "doc_id", "ordinal", *held).repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "doc_id", "ordinal").select("part", "doc_id", "ordinal", said.alias("words"))
    lists = dealt.mapInArrow(lambda batches: gathered(batches, mean), SCHEMAS["postings"].rpartition(",")[0]).withColumn("folder", folder(F.col("word")))
    lists.sortWithinPartitions("folder", "word", "part").write.partitionBy("folder").option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    files = -(-parts // LEXICON)  # of a folder of words
    total = Index(spark, path).table("postings").groupBy("folder", "word").agg(F.sum("postings").alias("postings"), F.sum("docs").alias("docs"))
    total.repartitionById(FOLDERS * files, F.col("folder") * files + F.pmod(F.hash("word"), F.lit(files))).sortWithinPartitions("word").write.partitionBy("folder").parquet(f"{path}/words")
    spark.createDataFrame([(n or 0, docs, mean, parts)], "chunks long, docs long, mean double, parts int").coalesce(1).write.parquet(f"{path}/totals")


def gathered(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """Chunks (part, doc_id, ordinal, words) in that order to rows of postings, one for each word and part; a part of very many words has several, cut between documents."""
    kept: pa.Table | None = None
    for b in batches:
        kept = pa.concat_tables([kept, pa.Table.from_batches([b])]) if kept is not None else pa.Table.from_batches([b])
        part, doc = (_numbers(kept[c]) for c in ("part", "doc_id"))
        fresh = np.flatnonzero(part[1:] != part[:-1]) + 1
        many = sum(len(c.flatten()) for c in kept["words"].chunks) > WORDS
        if many:  # the last document may go on in the next batch
            fresh = np.union1d(fresh, (np.flatnonzero((doc[1:] != doc[:-1]) | (part[1:] != part[:-1])) + 1)[-1:])
        at = 0
        for end in fresh:
            yield from _rows(kept.slice(at, end - at), mean)
            at = end
        kept = kept.slice(at)
    if kept is not None:
        yield from _rows(kept, mean)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values, nulls among them."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _rows(chunks: pa.Table, mean: float) -> Iterator[pa.RecordBatch]:
    """Chunks of one part to its rows of postings, by sorting the places of its words."""
    said = chunks["words"].combine_chunks()
    each, lengths = said.flatten(), pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(each):
        return
    coded = each.dictionary_encode()
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(each)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lengths) + row
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # of each posting its first place
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    tf, word, row = np.diff(np.r_[first, len(key)]), key[first] // len(lengths), key[first] % len(lengths)
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean))
    begun = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # of each word its first posting
    doc = _numbers(chunks["doc_id"])[row]
    opened = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])  # of each document in it, too
    runs, start = np.diff(np.r_[opened, len(word)]), np.searchsorted(opened, begun)
    lists = lambda at, n, values: pa.ListArray.from_arrays(pa.array(np.r_[at, n].astype(np.int32)), values)
    numbers = {"doc_id": chunks["doc_id"].combine_chunks().take(pa.array(row)), "ordinal": chunks["ordinal"].combine_chunks().take(pa.array(row)), "tf": pa.array(tf.astype(np.int32)), "impact": pa.array(impact), "gaps": lists(first, len(key), pa.array(gaps.astype(np.int32)))}
    out = {
        "word": coded.dictionary.take(pa.array(word[begun])), "part": pa.repeat(chunks["part"][0], len(begun)), "postings": pa.array(np.diff(np.r_[begun, len(word)])), "docs": pa.array(np.diff(np.r_[start, len(opened)])),
        "most": pa.array(np.maximum.reduceat(runs, start)), "tf": pa.array(np.maximum.reduceat(tf, begun).astype(np.int32)), "impact": pa.array(np.maximum.reduceat(impact, begun)),
        "held": lists(begun, len(word), pa.StructArray.from_arrays(list(numbers.values()), list(numbers))),
    }
    yield pa.RecordBatch.from_pydict(out)


SCHEMAS = {
    "postings": "word string, part int, postings long, docs long, most long, tf int, impact double, held array<struct<doc_id:bigint,ordinal:int,tf:int,impact:double,gaps:array<int>>>, folder int",
    "words": "word string, postings long, docs long, folder int",
    "chunks": "part int, doc_id long, ordinal int, chunk string, length int",
    "totals": "chunks long, docs long, mean double, parts int",
}


@dataclass
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def of(self, name: str, words: list[str]) -> DataFrame:
        """Rows of the words in a table that lies in folders by word."""
        folders = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "word string").select(folder(F.col("word"))).distinct().collect()] if words else []
        return self.table(name).where(F.col("folder").isin(folders) & F.col("word").isin(words))

    def weights(self, words: list[str]) -> dict[str, float]:
        """How rare each word is; a word that no chunk holds is missing."""
        n = self.table("totals").first().chunks
        idf = F.log(1 + (F.lit(float(n)) - F.col("postings") + 0.5) / (F.col("postings") + 0.5))
        return {r.word: r.idf for r in self.of("words", words).select("word", idf.alias("idf")).collect()}

    def listed(self, words: list[str], parts: DataFrame | list[int] | None, *columns: str) -> DataFrame:
        """(word, part, doc_id, ordinal, ...): the postings of the words, a row each, of some parts or all."""
        rows = self.of("postings", words)
        if isinstance(parts, list):
            rows = rows.where(F.col("part").isin(parts))
        elif parts is not None:
            rows = rows.join(parts, "part", "left_semi")
        return rows.select("word", "part", F.inline(F.arrays_zip(*(f"held.{c}" for c in ("doc_id", "ordinal", *columns)))))

    def matched(self, words: list[str], parts: DataFrame | list[int] | None = None) -> DataFrame:
        """(doc_id, ordinal, part, hits, found): chunks that hold all words, how often they hold any, and each word with impact and gaps. No words match nothing."""
        words = sorted(set(words))
        rows = self.listed(words, parts, "tf", "impact", "gaps")
        rows = rows.groupBy("part", "doc_id", "ordinal").agg(F.sum("tf").alias("hits"), F.collect_list(F.struct("word", "impact", "gaps")).alias("found"))
        return rows.where(F.size("found") == len(words)) if words else rows.where("false")

    def counted(self, words: list[str], parts: DataFrame | list[int] | None = None, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, part, n_chunks, hits, ordinal): of each document (or of a few, docs) its chunks that hold all words, the most hits of one, and the first such chunk."""
        words = sorted(set(words))
        rows = self.listed(words, parts, "tf")
        rows = rows if docs is None else rows.join(F.broadcast(docs.select("doc_id")), "doc_id", "left_semi")
        both = rows.groupBy("part", "doc_id", "ordinal").agg(F.count("*").alias("n"), F.sum("tf").alias("hits")).where(F.col("n") == len(words) if words else F.lit(False))
        best = F.max_by("ordinal", F.struct("hits", -F.col("ordinal")))
        return both.groupBy("part", "doc_id").agg(F.count("*").alias("n_chunks"), F.max("hits").alias("hits"), best.alias("ordinal"))

    def bounds(self, words: list[str], idf: dict[str, float] | None = None) -> DataFrame:
        """(part, bound, docs, postings): the largest that a document of a part can have, chunks (or, with idf, score); parts that lack a word are left out."""
        words = sorted(set(words))
        skips = self.of("postings", words).groupBy("part", "word").agg(F.sum("postings").alias("postings"), F.sum("docs").alias("docs"), F.max("most").alias("most"), F.max("impact").alias("impact"))
        if idf is None:
            bound = F.min("most").cast("double")
        else:
            bound = F.sum(F.col("impact") * F.coalesce(*(F.when(F.col("word") == w, float(v)) for w, v in idf.items()), F.lit(0.0)))
        return skips.groupBy("part").agg(bound.alias("bound"), F.min("docs").alias("docs"), F.sum("postings").alias("postings"), F.count("*").alias("n")).where(F.col("n") == len(words)).drop("n")

    def reachable(self, words: list[str], k: int, scored, idf: dict[str, float] | None = None) -> list[int] | DataFrame | None:
        """The parts that can hold one of the k best documents; None for all.

        scored(parts) gives the scores of those parts' documents as a column `score`. The parts of the largest bounds are
        searched first; the k-th score there is one that no worse part needs to be read for.
        """
        told = self.bounds(words, idf)
        total = told.agg(F.sum("postings")).first()[0] or 0
        if total <= PLAIN:
            return None
        first = [r.part for r in told.orderBy(F.desc("bound"), "part").limit(FIRST).collect()]
        scores = [r.score for r in scored(first).select("score").orderBy(F.desc("score")).limit(k).collect()] if k <= 10_000 else []
        if len(scores) < k:
            return None
        left = told.where(F.col("bound") >= scores[-1] - 1e-6).select("part")
        return [r.part for r in left.collect()] if left.count() <= LISTED else left

    def with_text(self, rows: DataFrame, most: int = 500, few: bool = False) -> DataFrame:
        """rows (part, doc_id, ordinal, ...) with the first characters of their chunk as snippet; of few rows, as a page or the best have, the places go to the chunks, so that no other chunk is shuffled."""
        place = ["part", "doc_id", "ordinal"]
        chunks = self.table("chunks")
        chunks = chunks.join(F.broadcast(rows.select(place)), place, "left_semi") if few else chunks
        return rows.join(chunks.select(*place, F.substring("chunk", 1, most).alias("snippet")), place, "left").drop("part", "ordinal")

    def tier(self, words: list[str], k: int) -> DataFrame:
        """(doc_id, rank, n_chunks, snippet): the k documents with most chunks that hold all words."""
        parts = self.reachable(words, k, lambda p: self.counted(words, p).withColumnRenamed("n_chunks", "score"))
        top = self.counted(words, parts).orderBy(F.desc("n_chunks"), "doc_id").limit(k)
        rank = F.row_number().over(Window.orderBy(F.desc("n_chunks"), "doc_id"))  # k rows at most
        return self.with_text(top.withColumn("rank", rank), few=True).select("doc_id", "rank", "n_chunks", "snippet")

    def scores(self, words: list[str], idf: dict[str, float], parts: DataFrame | list[int] | None = None) -> DataFrame:
        """(part, doc_id, ordinal, score) of the chunks that hold all words: see ranked()."""
        m = len(set(words))
        rows = self.matched(words, parts)
        gain = F.aggregate("found", F.lit(0.0), lambda a, x: a + x["impact"] * F.coalesce(*(F.when(x["word"] == w, float(v)) for w, v in sorted(idf.items())), F.lit(0.0)))
        return rows.select("part", "doc_id", "ordinal", F.round(gain * (1 + F.lit(float(m)) / cover(F.col("found.gaps"))) / 2, 6).alias("score"))

    def ranked(self, words: list[str], k: int | None = None) -> DataFrame:
        """(doc_id, score, snippet): documents by their best chunk, which holds all words; k of them, or all.

        A chunk's score is the sum, over the words, of rarity times a saturating count that longer chunks lessen; it counts
        in full where the words stand side by side in any order, and goes to half as the shortest stretch that holds all of them grows.
        """
        words = sorted(set(words))
        idf = self.weights(words)
        per_doc = lambda parts: self.scores(words, idf, parts).groupBy("part", "doc_id").agg(F.max_by(F.struct("score", "ordinal"), F.struct("score", -F.col("ordinal"))).alias("b")).select("part", "doc_id", "b.*")
        parts = self.reachable(words, k, per_doc, idf) if k else None
        best = per_doc(parts)
        if k:
            best = best.orderBy(F.desc("score"), "doc_id").limit(k)
        return self.with_text(best, few=bool(k)).select("doc_id", "score", "snippet")

    def phrase(self, words: list[str]) -> DataFrame:
        """(doc_id, ordinal, places): chunks in which the words follow one another, with the places where they begin."""
        rows = self.matched(words)
        if not words:
            return rows.select("doc_id", "ordinal", F.array().cast("array<int>").alias("places"))
        gaps = lambda w: F.get(F.filter("found", lambda x: x["word"] == w), F.lit(0))["gaps"]
        return rows.select("doc_id", "ordinal", begun(F.array(*map(gaps, words))).alias("places")).where(F.size("places") > 0)


def _udf(fn, kind: str, gaps: Column) -> Column:
    """fn of each row's lists of places, which are told as gaps."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda lists: fn([np.cumsum(x, dtype=np.int64) for x in lists]))

    return F.pandas_udf(run, kind)(gaps)


def begun(gaps: Column) -> Column:
    """The places from which on the first list holds one, the second the next one, and so on."""

    def one(places: list[np.ndarray]) -> list[int]:
        starts = places[0]
        for i, p in enumerate(places[1:], 1):
            starts = np.intersect1d(starts, p - i, assume_unique=True)
        return starts.tolist()

    return _udf(one, "array<int>", gaps)


def cover(gaps: Column) -> Column:
    """The number of places of the shortest stretch that holds one of each list: each place as its end, with the last of every list up to there."""

    def one(places: list[np.ndarray]) -> float:
        ends = np.concatenate(places)
        last = [np.r_[-(1 << 40), p][np.searchsorted(p, ends, "right")] for p in places]
        return float((ends - np.minimum.reduce(last)).min() + 1)

    return _udf(one, "double", gaps)
