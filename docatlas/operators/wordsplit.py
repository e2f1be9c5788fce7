"""Words that were run together, taken apart by how often their parts occur: as joins of their stretches with known words.

Only words that nobody knows are looked at, each once however often it occurs. All stretches of such a word are looked up at
once; the parts that are most likely by their frequencies are then the cheapest way from its first letter to its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a part at most and of a word that is looked at, known words up to which they are broadcast, parts of a larger look-up.
LONGEST, MOST, SMALL, SALT = 24, 60, 200_000, 16
#: What a part costs besides its rarity, so that few long parts are preferred to many short ones.
PART_COST = 4.0


def costs(known: DataFrame) -> DataFrame:
    """known (word, n) to (word, cost): the rarer, the dearer. Words of one letter are parts only if they are a or i."""
    total = known.agg(F.sum("n").alias("total"))
    low = known.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).where((F.length("word") > 1) | F.col("word").isin("a", "i"))
    return low.join(F.broadcast(total)).select("word", (F.log(F.col("total") / F.col("n")) + PART_COST).alias("cost"))


def _looked_up(rows: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    if few:
        return rows.join(F.broadcast(known), "word")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("whole"), F.lit(SALT)).cast("int")).join(salted, ["word", "salt"]).drop("salt")


def _cheapest(edges: Column, size: Column) -> Column:
    """edges (e, s, cost), sorted, to the ends of the parts of the cheapest way from 0 to size; null where there is none."""
    nowhere = F.lit(None).cast("double")
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("s")))

    def reach(best: Column, end: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: (x["e"] == end) & F.get(best, x["s"])["cost"].isNotNull()), lambda x: F.struct((F.get(best, x["s"])["cost"] + x["cost"]).alias("cost"), x["s"].alias("s")))
        return F.concat(best, F.array(F.coalesce(F.array_min(ways), F.struct(nowhere.alias("cost"), F.lit(0).alias("s")))))

    table = F.aggregate(F.sequence(F.lit(1), size), start, reach)
    back = lambda t: F.aggregate(F.sequence(F.lit(1), size), F.struct(size.alias("at"), F.array(size).alias("ends")), lambda a, _: F.when(a["at"] <= 0, a).otherwise(F.struct(F.get(t, a["at"])["s"].alias("at"), F.concat(F.array(F.get(t, a["at"])["s"]), a["ends"]).alias("ends"))), lambda a: a["ends"])
    held = F.transform(F.array(table), lambda t: F.when(F.get(t, size)["cost"].isNotNull(), back(t)))
    return F.get(held, F.lit(0))


def taken_apart(words: DataFrame, known: DataFrame) -> DataFrame:
    """words (word) and known (word, n) to (word, parts): each different unknown word of letters that known parts make up, with the cheapest ones.

    Case does not matter for the look-up and stays in the parts; words of more than MOST letters, and those that need an unknown
    part, have no row.
    """
    priced = costs(known)
    few = priced.count() <= SMALL
    low = known.select(F.lower("word").alias("low"))
    asked = words.select("word").distinct().where(F.col("word").rlike(r"^\p{L}+$") & F.length("word").between(2, MOST)).withColumn("low", F.lower("word"))
    asked = asked.join(low.distinct(), "low", "left_anti").where(F.length("low") == F.length("word"))
    n = F.length("low")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(F.sequence(s + 1, F.least(n, s + LONGEST)), lambda e: F.struct(e.alias("e"), s.alias("s")))))
    rows = asked.select(F.col("low").alias("whole"), F.explode(spans).alias("x")).distinct().select("whole", "x.e", "x.s", F.col("whole").substr(F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("word"))
    edges = _looked_up(rows, priced, few).groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("e", "s", "cost"))).alias("edges"))
    ends = edges.select(F.col("whole").alias("low"), _cheapest(F.col("edges"), F.length("whole")).alias("ends")).where("ends is not null")
    got = asked.join(ends, "low")
    parts = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.col("word").substr(F.get("ends", i - 1) + 1, F.get("ends", i) - F.get("ends", i - 1)))
    return got.select("word", parts.alias("parts")).where(F.size("parts") > 1)


def rejoined(tokens: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """tokens (line, at, word) of bare words to (line, at, upto, word): unknown tokens that with up to `most` after them make a known word, the first such; from left to right, none used twice.

    line is any key of a stretch of text that one task can hold.
    """
    words = known.select(F.lower("word").alias("low")).distinct()
    lists = tokens.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("t"))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.size("t") - 1 - i)), lambda j: F.struct(i.alias("i"), (i + j).alias("j"), F.array_join(F.transform(F.slice("t", i + 1, j + 1), lambda x: x["word"]), "").alias("word")))))
    rows = lists.select("line", F.explode(spans).alias("x")).select("line", "x.*").withColumn("low", F.lower("word"))
    hits = rows.join(words, "low", "left_semi")
    alone = hits.where("i = j").select("line", "i")
    first = hits.join(alone, ["line", "i"], "left_anti").groupBy("line", "i").agg(F.min(F.struct("j", "word")).alias("b")).select("line", "i", "b.*")
    order = first.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("i", "j", "word"))).alias("f"))
    nothing = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<struct<i:int,j:int,word:string>>").alias("kept"))
    kept = F.aggregate("f", nothing, lambda a, x: F.when(x["i"] > a["upto"], F.struct(x["j"].alias("upto"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return order.join(lists, "line").select("line", "t", F.explode(kept).alias("x")).select("line", F.get("t", F.col("x.i"))["at"].alias("at"), F.get("t", F.col("x.j"))["at"].alias("upto"), "x.word")
