"""Ranked lexical search by three phases over term-partitioned postings, each list in order of impact.

The heads of an item's lists tell documents whose scores give a lower bound of its k-th. No document can be among the best whose postings all lie
below an equal share of that bound, so each list is read down to there; sums of what was read bound the scores from below and
above, and the documents that can still be among the best are looked up in all lists. Where those are too many, as long items
make the shares small, lists are read down to a part of the share first, what was read before left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Results of an item, postings of a list's head, rows up to which a table of the items' side is broadcast, terms looked for in one pass over the documents.
BEST, HEAD, SMALL, VOCABULARY = 10, 100, 200_000, 400_000
#: Documents, as a multiple of the results, whose whole scores give the lower bound: those of the largest sums over the heads.
TRIED = 10
#: By how much a further round, where too many documents can still be among the best, reads deeper.
DEEPER = 4
#: Parts over which a row of a larger table of the items' side is dealt out.
SALT = 16
#: Every byte as it counts: A-Z in lower case, what belongs to no term a blank.
_FOLD = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [Counter((t or b"").translate(_FOLD).split()) for t in b.column("text").to_pylist()]
        ids = [i for i, c in zip(b.column("item_id").to_pylist(), counts, strict=True) for _ in c]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t.decode("utf-8", "replace") for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["item_id", "word", "times"])


def wanted(items: DataFrame) -> DataFrame:
    """(item_id, text) to (item_id, term, word, times, lists): term is a number that no other word has."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    q = common.written(rows.mapInArrow(_terms, "item_id long, word string, times long").groupBy("item_id", "word").agg(F.sum("times").alias("times")), "ranked-items")
    for seed in range(8):
        words = q.select("word").distinct().select(F.xxhash64("word", F.lit(seed)).alias("term"))
        if words.groupBy("term").count().where("count > 1").isEmpty():
            break
    lists = q.groupBy("item_id").agg(F.count("*").alias("lists"))
    return common.written(q.join(lists, "item_id").withColumn("term", F.xxhash64("word", F.lit(seed))), "ranked-terms")


def postings(docs: DataFrame, words: dict[bytes, int], stats: bool) -> DataFrame:
    """(uid, doc_id, text) to (term, uid, doc_id, tf, n); with stats, a row of a batch without a term has its documents that hold any as tf, and all their terms as n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeping("ranked")
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            some = total = 0
            for uid, doc, text in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
                ws = text.translate(_FOLD).split() if text else []
                n = len(ws)
                some, total = some + (n > 0), total + n
                hit = [(words[w], c) for w, c in Counter(ws).items() if w in words]
                for col, v in zip(cols, ([t for t, _ in hit], [uid] * len(hit), [doc] * len(hit), [c for _, c in hit], [n] * len(hit)), strict=True):
                    col.extend(v)
            if stats:
                for col, v in zip(cols, (None, None, None, some, total), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["term", "uid", "doc_id", "tf", "n"])

    return docs.mapInArrow(run, "term long, uid long, doc_id long, tf long, n long")


def index(docs: DataFrame, q: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, int]:
    """Postings (term, uid, doc_id, impact) of the words of q and the number of documents that hold any terms; written in ranges of term and impact: a long list takes many ranges, and none is dealt by its term alone."""
    spark = docs.sparkSession
    common.tune(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    known = q.select("word", "term").distinct()
    passes = known.count() // VOCABULARY + 1
    raw = None
    for i in range(passes):
        some = known.where(F.pmod("term", F.lit(passes)) == i).collect()  # VOCABULARY words or so
        part = scratch.written(postings(texts, {r.word.encode(): r.term for r in some}, i == 0), "ranked-raw", "zstd")
        raw = part if raw is None else raw.union(part)
    n, length = raw.where("term is null").agg(F.sum("tf"), F.sum("n")).first()
    m = F.lit(25) + F.expr(f"(75 * n * {n or 0}) div {length or 1}")
    rows = raw.where("term is not null").withColumn("m", m).selectExpr("term", "uid", "doc_id", "(1000000000 * tf) div (1000 * tf + 8 * m) as impact")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = scratch.written(rows.repartitionByRange(parts, "term", "impact", "uid").sortWithinPartitions("term", F.desc("impact")), "ranked-index", "zstd")
    scratch.dropped("ranked-raw")
    return lists, int(n or 0)


def _beside(big: DataFrame, small: DataFrame, on: list[str], rows: int) -> DataFrame:
    """big joined with a table of the items' side: broadcast if that has SMALL rows at most, else dealt out over SALT parts, so that a frequent term is in many tasks."""
    if rows <= SMALL:
        return big.join(F.broadcast(small), on)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return big.withColumn("salt", F.pmod("uid", F.lit(SALT)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(item_id, name): the k-th largest sum of an item, 0 where it has fewer."""
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("low")))).where(F.col("r") <= k)
    return top.groupBy("item_id").agg(F.max(F.when(F.col("r") == k, F.col("low")).otherwise(0)).alias(name))


def _scores(lists: DataFrame, q: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """pairs (item_id, uid) to (item_id, uid, doc_id, score), looked up in all lists of the item. rows: those of q."""
    some = pairs.count()
    small = lambda t, n: F.broadcast(t) if n <= SMALL else t.hint("shuffle_hash")
    rest = lists.join(small(pairs, some), "uid")
    return rest.join(small(q, rows), ["item_id", "term"]).groupBy("item_id", "uid", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) to (item_id, rank, doc_id, score), the k best documents of each item.

    Null and empty texts hold no terms and are no documents of the statistics; texts of any length are read whole. Rows
    that repeat a doc_id are documents of their own, one without an id comes after equals; equal scores rank by
    doc_id. Items of one item_id are one item of all their terms, items without an id are ignored, items without terms or
    without documents give no rows; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        q = wanted(items)
        lists, n = index(docs, q, scratch)
        df = lists.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
        q = scratch.written(q.join(df, "term").select("item_id", "term", "lists", "top", (weight * F.col("times")).cast("long").alias("w")), "ranked-weights")
        rows = q.count()
        gain = (F.col("w") * F.col("impact")).alias("gain")

        heads = lists.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "uid"))).where(F.col("r") <= max(k, HEAD))
        first = _beside(heads, q, ["term"], rows).groupBy("item_id", "uid").agg(F.sum(gain).alias("low"))
        tried = first.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("low"), "uid"))).where(F.col("r") <= TRIED * k)
        tried = scratch.written(_scores(lists, q, scratch.written(tried.select("item_id", "uid"), "ranked-tried"), rows), "ranked-bounds").withColumnRenamed("score", "low")
        bounds = scratch.written(q.select("item_id", "lists").distinct().join(_kth(tried, k, "floor"), "item_id", "left").selectExpr("item_id", "coalesce(floor, 0) div lists as cut"), "ranked-floors")
        cuts, round_, known = bounds, 0, tried.select("item_id", "uid", "low")
        while True:
            # What a list can add that was not read: less than the cut, and no more than its head has.
            now = q.join(cuts, "item_id").withColumn("unread", F.least("cut", F.col("w") * F.col("top")))
            now = now.withColumn("least", F.ceil(F.col("cut") / F.greatest(F.col("w"), F.lit(1))) - 1)
            now = scratch.written(now.join(now.groupBy("item_id").agg(F.sum("unread").alias("all")), "item_id"), f"ranked-cuts{round_}")
            # A list is read down to its lowest cut of any item before its items are joined; what lies above the last cut was read.
            lowest = now.groupBy("term").agg(F.min("least").alias("lowest"))
            read = _beside(lists, lowest, ["term"], rows).where("impact >= lowest").drop("lowest")
            read = _beside(read, now, ["term"], rows).where((F.col("w") * F.col("impact") >= F.col("cut")) & (F.col("w") * F.col("impact") > 0))
            read = read if round_ == 0 else read.where(F.col("w") * F.col("impact") < F.col("above"))
            more = read.groupBy("item_id", "uid").agg(F.sum(gain).alias("low"), F.count("*").alias("n"))
            if round_:  # only of what is still open
                more = open_.join(more.withColumnsRenamed({"low": "gained", "n": "seen"}), ["item_id", "uid"], "left").select("item_id", "uid", (F.col("low") + F.coalesce("gained", F.lit(0))).alias("low"), (F.col("n") + F.coalesce("seen", F.lit(0))).alias("n"))
            sums = scratch.written(more, f"ranked-sums{round_}")
            sure = sums.select("item_id", "uid", "low").unionByName(known).groupBy("item_id", "uid").agg(F.max("low").alias("low"))
            floors = _kth(sure, k, "floor").join(now.select("item_id", "cut", "all").distinct(), "item_id")
            open_ = scratch.written(sums.join(floors, "item_id").where("low + all - n * cut >= floor").select("item_id", "uid", "low", "n"), f"ranked-open{round_}")
            if open_.count() <= SMALL or not cuts.agg(F.max("cut")).first()[0]:
                break
            cuts, round_ = scratch.written(cuts.selectExpr("item_id", f"cut div {DEEPER} as cut", "cut as above"), f"ranked-floors{round_}"), round_ + 1

        open_ = open_.select("item_id", "uid")
        exact = _scores(lists, q, open_, rows)
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid"))
        best = exact.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
        return common.written(best.select("item_id", "rank", "doc_id", "score"), "ranked-best")
