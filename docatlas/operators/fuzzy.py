"""Catalogue search that tolerates typing errors, by deletion neighbourhoods.

Two words that are a few edits apart become the same when a few letters are struck from each. So each word of the catalogue is
kept under all that is left of it, and a join on what is left of the question's words finds the few that can be near, which
are then measured. No word is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(length: Column) -> Column:
    """Edits that a word of the question may be away: none up to two letters, one up to five, else two."""
    return F.when(length <= 2, 0).when(length <= 5, 1).otherwise(2)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _struck(word: Column) -> Column:
    """What is left of a word without one letter, for each letter."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def neighbourhood(word: Column, depth: Column) -> Column:
    """A word and all that is left of it without up to `depth` letters (two at most)."""
    none = F.array().cast("array<string>")
    one = F.when((depth > 0) & (F.length(word) > 0), _struck(word)).otherwise(none)
    two = F.when((depth > 1) & (F.length(word) > 1), F.flatten(F.transform(one, _struck))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), one, two))


def index(rows: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a catalogue to postings (word, field, key) and keys (left, word) of its different words. Write both; they serve any question."""
    each = None
    for f in fields:
        part = rows.select(F.col(key).alias("key"), F.lit(f).alias("field"), F.explode(F.array_distinct(words(F.col(f)))).alias("word"))
        each = part if each is None else each.unionAll(part)
    n = F.length("word")
    # A word can be two edits from one of six letters or more, and one from one of three or more.
    depth = F.when(n >= 4, 2).when(n >= 2, 1).otherwise(0)
    left = each.select("word").distinct().select(F.explode(neighbourhood(F.col("word"), depth)).alias("left"), "word")
    return each, left


def near(left: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (word) and keys (left, word) to (asked, word, distance): the words within the edits that the asked one allows."""
    a = asked.select(F.col("word").alias("asked")).distinct().withColumn("most", allowed(F.length("asked")))
    keys = a.select("asked", "most", F.explode(neighbourhood(F.col("asked"), F.col("most"))).alias("left"))
    pairs = keys.join(left, "left").select("asked", "word", "most").distinct()
    return pairs.withColumn("distance", F.levenshtein("asked", "word")).where(F.col("distance") <= F.col("most")).drop("most")


def search(postings: DataFrame, left: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """questions (query_id, text) to (query_id, rank, key, field, score): the k rows whose best field holds most of the question.

    A field's score is the sum over the question's words of the best match there, 1 for the word itself and less by the
    share of its letters that an edit takes. Equal scores rank by key; the first field by name tells which. A question without
    words finds nothing.
    """
    # Questions of the same words are asked once, rows of the same words in the same fields are scored once: of each such class the first k keys can be among the best.
    q = questions.select("query_id", F.array_sort(F.array_distinct(words(F.col("text")))).alias("asking")).where(F.size("asking") > 0)
    held = postings.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("field", "word"))).alias("held"))
    few = held.withColumn("n", F.row_number().over(Window.partitionBy("held").orderBy("key"))).where(F.col("n") <= k)
    keys = few.withColumn("first", F.min("key").over(Window.partitionBy("held")))
    firsts = keys.where("n = 1").select("first", F.explode("held").alias("h")).select("first", "h.field", "h.word")
    asked = q.select("asking").distinct().select("asking", F.explode("asking").alias("asked"))
    told = near(left, asked.select(F.col("asked").alias("word"))).withColumn("worth", 1 - F.col("distance") / F.length("asked"))
    hits = asked.join(told, "asked").join(firsts, "word").groupBy("asking", "first", "field", "asked").agg(F.max("worth").alias("worth"))
    fields = hits.groupBy("asking", "first", "field").agg(F.round(F.sum("worth"), 6).alias("score"))
    best = fields.groupBy("asking", "first").agg(F.min(F.struct((-F.col("score")).alias("s"), "field")).alias("b")).select("asking", "first", "b.field", (-F.col("b.s")).alias("score"))
    rank = lambda by: F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), by))
    classes = best.withColumn("rank", rank("first")).where(F.col("rank") <= k).drop("rank")
    rows = classes.join(keys.select("first", "key"), "first").withColumn("rank", rank("key")).where(F.col("rank") <= k)
    return q.join(rows, "asking").select("query_id", "rank", "key", "field", "score")
