"""Tokens on pages: runs of one look, sentences from places, gaps that a redaction left. Tokens are (page, no, text, x, y, width, font)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prose

#: Width of a character as a share of its font's size, where nothing better is known.
CHARACTER = 0.55


def _before(column: str) -> Column:
    return F.lag(column).over(Window.partitionBy("page").orderBy("no"))


def estimated_width(text: Column, font: Column) -> Column:
    return F.length(text) * font * CHARACTER


def runs(tokens: DataFrame) -> DataFrame:
    """(page, run, text, x, y, font): tokens go on in one run until the font changes by more than 1, the line by more than half a font, or a gap exceeds 0.6 of it."""
    gap = F.col("x") - (_before("x") + _before("width"))
    fresh = _before("x").isNull() | (F.abs(F.col("font") - _before("font")) > 1) | (F.abs(F.col("y") - _before("y")) > 0.5 * F.col("font")) | (gap > 0.6 * F.col("font"))
    rows = tokens.withColumn("first", F.when(fresh, 1).otherwise(0)).withColumn("run", F.sum("first").over(Window.partitionBy("page").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "text"))), lambda t: t["text"]), "")
    return rows.groupBy("page", "run").agg(said.alias("text"), F.min("x").alias("x"), F.min_by("y", "no").alias("y"), F.min_by("font", "no").alias("font"))


def redactions(tokens: DataFrame, email: bool = False) -> DataFrame:
    """(page, no, characters, marker): gaps on a line wider than three fonts, one and a half in a mail's head, as so many characters of the line's usual width."""
    gap = F.col("x") - (_before("x") + _before("width"))
    line = (F.abs(F.col("y") - _before("y")) <= 0.5 * F.col("font")) & (gap > (1.5 if email else 3.0) * F.col("font"))
    usual = F.avg(F.col("width") / F.greatest(F.lit(1), F.length("text"))).over(Window.partitionBy("page").orderBy("no").rowsBetween(-5, 4))
    rows = tokens.select("page", "no", gap.alias("gap"), line.alias("wide"), usual.alias("usual")).where("wide")
    count = F.greatest(F.lit(1), F.round(F.col("gap") / F.col("usual")).cast("int"))
    name = "redact.email.char" if email else "redact.char"
    return rows.select("page", "no", count.alias("characters"), F.concat(F.lit(f"[{name}("), count.cast("string"), F.lit(")]")).alias("marker"))


def page_count(tokens: DataFrame) -> DataFrame:
    return tokens.agg((F.coalesce(F.max("page"), F.lit(-1)) + 1).alias("pages"))


def sentences(tokens: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(page, sentence, text): tokens that no redaction (page, no) covers, with blanks where a gap or a new line is.

    A full stop closes a sentence unless a digit or small letter follows, or an abbreviation or a single capital stands
    before it; ! and ? close one, and so does a page's end.
    """
    seen = tokens if hidden is None else tokens.join(hidden, ["page", "no"], "left_anti")
    w = Window.partitionBy("page").orderBy("no")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    apart = F.lag("x").over(w).isNotNull() & ((gap > 0.2 * F.col("font")) | (F.abs(F.col("y") - F.lag("y").over(w)) > 0.5 * F.col("font")) | (F.lag("text").over(w).rlike(r"[\p{P}]$") & F.col("text").rlike(r"^\p{L}")))
    following = F.coalesce(F.lead("text").over(w), F.lit(""))
    word = F.regexp_extract("text", r"([\p{L}]*)\.$", 1)
    stop = F.col("text").rlike(r"\.$") & ~following.rlike(r"^[\p{Nd}\p{Ll}]") & ~prose.is_abbreviation(word) & ~word.rlike(r"^\p{Lu}$")
    ends = stop | F.col("text").rlike("[!?]$")
    rows = seen.select("page", "no", F.concat(F.when(apart, " ").otherwise(""), "text").alias("said"), F.when(ends, 1).otherwise(0).alias("end"))
    rows = rows.withColumn("sentence", F.coalesce(F.sum("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.groupBy("page", "sentence").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "said"))), lambda t: t["said"]), "")).alias("text"))


def read_order(fragments: DataFrame) -> DataFrame:
    """Fragments (page, no, text, x, y, width, height) with their place in reading order, and whether a line begins or a blank stands before them.

    Fragments at most 2.5 below the one above are level with it and go from left to right. A line begins where the height on the
    page changes by more than 0.3 of the fragment's own, a blank stands where a gap exceeds 0.15 of it.
    """
    down, across = Window.partitionBy("page").orderBy("y", "x", "no"), Window.partitionBy("page").orderBy("band", "x", "no")
    band = F.when(F.col("y") - F.lag("y").over(down) > 2.5, 1).otherwise(0)
    rows = fragments.withColumn("step", band).withColumn("band", F.sum("step").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("step")
    line = F.coalesce(F.abs(F.col("y") - F.lag("y").over(across)) > 0.3 * F.col("height"), F.lit(True))
    gap = F.col("x") - (F.lag("x").over(across) + F.lag("width").over(across))
    blank = ~line & (gap > 0.15 * F.col("height")) & ~F.endswith(F.lag("text").over(across), F.lit(" "))
    return rows.select("page", "no", "text", F.row_number().over(across).alias("place"), line.alias("line"), F.coalesce(blank, F.lit(False)).alias("blank"))


def page_texts(ordered: DataFrame) -> DataFrame:
    """(page, text) of what read_order gives."""
    said = F.concat(F.when(F.col("blank"), " ").otherwise(""), "text")
    return ordered.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", said.alias("said")))), lambda t: t["said"]), "").alias("text"))


def richer(text: Column, other: Column) -> Column:
    """The other extraction of a text if it has more words, else the text."""
    from . import text as T

    words = lambda c: F.coalesce(T.word_count(c), F.lit(0))
    return F.when(words(other) > words(text), other).otherwise(text)
