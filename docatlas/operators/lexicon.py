"""A lexicon as tables: entries to senses, a web of words, look-ups with user words and lemmas, senses in context, facts, validity.

Tables: senses (headword, sense_id, text), synonyms (headword, sense_id or null, other), all words compared in lower case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docatlas.functions import text as T
from docatlas.operators import graph

# Codes of relations between facts' ends.
RELATIONS = {
    "est": 1, "idem": 2, "contra": 3, "diversum": 4, "nexus": 5, "pars": 20, "totum": 21, "situ": 22, "causa": 40, "ortus": 41, "cor": 42, "obsta": 43,
    "post": 60, "dum": 61, "usus": 80, "per": 81, "ligat": 100, "affinis": 101, "donat": 102, "solvit": 103, "genoma": 120, "locus": 121, "mutatio": 122, "codex": 123,
}
# Relations that are read from text.
READ_RELATIONS = ("est", "idem", "contra", "pars", "situ", "totum", "causa", "dum", "diversum", "obsta", "ortus", "usus")
# Parts of speech in the order in which they are looked for.
PARTS = ("conjunction", "noun", "verb", "adjective", "adverb")
_CUT, _END = "\ue000", "\ue001"


def part_of_speech(text: Column) -> Column:
    """The first of PARTS whose name with a full stop is in a text ("verb." is in "adverb." too); else unknown."""
    return F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(f"{p}.")), F.lit(p)) for p in PARTS), F.lit("unknown"))


def senses_of(entries: DataFrame) -> DataFrame:
    """Entries (headword, raw) to senses: lines "N. () text", cut again at marks a. (a) A. IV. into N:mark."""
    line = entries.select("headword", F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))
    number, said = F.regexp_extract("line", r"^([0-9]+)\.\s*\(\)\s*(.*)", 1), F.regexp_extract("line", r"^([0-9]+)\.\s*\(\)\s*(.*)", 2)
    decoded = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#038;", "&"), ("&amp;", "&")), said)
    marked = F.regexp_replace(decoded, r"\s+(?:([a-z])\.|\(([a-z])\)|([A-Z])\.|([IVX]+)\.)\s+", f"{_CUT}$1$2$3$4{_END}")
    rows = line.where("line rlike '^[0-9]+\\\\.\\\\s*\\\\(\\\\)'").select("headword", "line_no", number.alias("number"), F.posexplode(F.split(marked, _CUT)).alias("part_no", "part"))
    mark = F.when(F.col("part_no") > 0, F.split_part("part", F.lit(_END), F.lit(1)))
    text = F.trim(F.when(F.col("part_no") > 0, F.split_part("part", F.lit(_END), F.lit(2))).otherwise(F.col("part")))
    return rows.select("headword", F.concat_ws(":", "number", mark).alias("sense_id"), text.alias("text"), "line_no", "part_no").where("text <> ''")


def web(words: DataFrame) -> DataFrame:
    """Words (place, word) to a vocabulary (word_id, key, shown): ids in first-seen order, each the place of its word's first sight.

    A word is shown in lower case as soon as it was met so, else as a title, else in capitals.
    """
    w = F.col("word")
    rank = F.when(w == F.lower(w), 0).when(w == F.initcap(w), 1).otherwise(2)
    return words.groupBy(F.lower(w).alias("key")).agg(F.min("place").alias("word_id"), F.min_by(w, F.struct(rank, F.col("place"))).alias("shown"))


def edges(senses: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(src, dst, kind) of three kinds: synonyms of words, synonyms of senses, and words of two letters or more in definitions."""
    s = synonyms.select(F.lower("headword").alias("src"), F.lower("other").alias("dst"), F.when(F.col("sense_id").isNull(), "word").otherwise("sense").alias("kind"))
    both = s.union(s.select("dst", "src", "kind"))
    words = senses.select(F.lower("headword").alias("src"), F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("dst"), F.lit("definition").alias("kind"))
    return both.union(words.where("length(dst) >= 2")).where("src <> dst").distinct()


def semantic_distances(pairs: DataFrame, senses: DataFrame, synonyms: DataFrame, depth: int = 3) -> DataFrame:
    """pairs (source, target) with the fewest steps over edges of all kinds; 0 for the same word, -1 beyond depth."""
    return graph.distances(pairs.select(F.lower("source").alias("source"), F.lower("target").alias("target")), edges(senses, synonyms), depth)


def looked_up(words: DataFrame, lexicon: DataFrame, user: DataFrame | None = None, lemmas: bool = True) -> DataFrame:
    """Words (..., word) with concept and form: the first lemma form that is known, in the user's words before the lexicon's.

    lexicon and user: (word, concept); the user's concepts are negative by convention. Words that nothing knows keep null.
    """
    known = lexicon.select(F.lower("word").alias("form"), "concept", F.lit(1).alias("source"))
    if user is not None:
        known = known.unionByName(user.select(F.lower("word").alias("form"), "concept", F.lit(0).alias("source")))
    best = known.groupBy("form").agg(F.min_by("concept", F.struct("source", "concept")).alias("concept"))
    different = words.select("word").distinct()
    forms = F.transform(T.lemma_forms(F.col("word")), lambda w: F.lower(w)) if lemmas else F.array(F.lower("word"))
    tried = different.select("word", F.posexplode(forms).alias("n", "form")).join(best, "form")
    hit = tried.groupBy("word").agg(F.min_by(F.struct("concept", "form"), "n").alias("hit")).select("word", "hit.*")
    return words.join(hit, "word", "left")


def concepts(docs: DataFrame, lexicon: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, ordinal, word, concept): the words that resolve to a concept, by place."""
    words = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"[^\p{L}\p{N}']+"), lambda w: w != "")).alias("ordinal", "word"))
    return looked_up(words, lexicon, user).where("concept is not null").select("doc_id", "ordinal", "word", "concept")


def prefixed(senses: DataFrame, prefix: str, part: str | None = None) -> DataFrame:
    """Senses of headwords that begin with a prefix, of words that have any sense of a part of speech."""
    some = senses.where(F.lower("headword").startswith(prefix.lower()))
    if part is None:
        return some
    held = some.where(part_of_speech(F.col("text")) == part.lower()).select(F.lower("headword").alias("k")).distinct()
    return some.join(held, F.lower("headword") == F.col("k"), "left_semi")


def disambiguated(occurrences: DataFrame, mined: DataFrame, rules: DataFrame, reach: int = 5) -> DataFrame:
    """Occurrences (id, word, words, at) to (id, word, sense_id, confidence): by what stands up to `reach` places around.

    mined (word, sense_id, context, weight): the sense of most matches times weight, with confidence .5 + .15 a match, 1 at
    most; if that is .5 or less, rules of the same shape: the matching one of greatest weight; else a word with rules has
    its first sense at 0.5, and any other is unknown at 0.
    """
    near = F.filter(F.col("words"), lambda w, i: (i != F.col("at")) & (F.abs(i - F.col("at")) <= reach))
    o = occurrences.select("id", F.lower("word").alias("word"), F.array_distinct(F.transform(near, lambda w: F.lower(w))).alias("near"))

    def held(table: DataFrame) -> DataFrame:
        return table.select(F.lower("word").alias("word"), "sense_id", F.transform("context", lambda w: F.lower(w)).alias("context"), "weight")

    n = F.size(F.array_intersect("near", "context"))
    m = o.join(held(mined), "word").select("id", "sense_id", n.alias("n"), (n * F.col("weight")).alias("score")).where("n > 0")
    best = m.groupBy("id").agg(F.max_by(F.struct("sense_id", "n"), F.struct("score", "sense_id")).alias("b")).select("id", F.col("b.sense_id").alias("m_sense"), F.least(F.lit(1.0), 0.5 + 0.15 * F.col("b.n")).alias("m_conf"))
    r = o.join(held(rules), "word").select("id", "sense_id", n.alias("n"), "weight")
    ruled = r.groupBy("id").agg(F.max_by("sense_id", F.when(F.col("n") > 0, F.struct("weight", "sense_id"))).alias("r_sense"), F.max(F.when(F.col("n") > 0, F.col("weight"))).alias("r_conf"), F.min("sense_id").alias("first_sense"))
    told = o.join(best, "id", "left").join(ruled, "id", "left")
    sure = F.coalesce(F.col("m_conf"), F.lit(0.0)) > 0.5
    sense = F.when(sure, F.col("m_sense")).otherwise(F.coalesce("r_sense", "first_sense", F.lit("unknown")))
    conf = F.when(sure, F.col("m_conf")).when(F.col("r_conf").isNotNull(), F.col("r_conf")).when(F.col("first_sense").isNotNull(), 0.5).otherwise(0.0)
    return told.select("id", "word", sense.alias("sense_id"), F.round(conf, 6).alias("confidence"))


def drilled(senses: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Words (word) with all words of their definitions, and of those, down to a depth: (word, reached, level), the least level of each."""
    links = senses.select(F.lower("headword").alias("src"), F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("dst")).where("length(dst) >= 2").distinct()
    front = seen = start.select(F.lower("word").alias("word"), F.lower("word").alias("reached"), F.lit(0).alias("level")).distinct()
    for level in range(1, depth + 1):
        step = front.join(links, F.col("reached") == F.col("src")).select("word", F.col("dst").alias("reached")).distinct()
        front = step.join(seen.select("word", "reached"), ["word", "reached"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen.where("level > 0")


def usage(selections: DataFrame) -> DataFrame:
    """Selections (doc_id, ordinal, sense_id, at) to how many places each sense is chosen in now: a later choice takes an earlier one back."""
    now = selections.groupBy("doc_id", "ordinal").agg(F.max_by("sense_id", F.struct("at", "sense_id")).alias("sense_id"))
    return now.groupBy("sense_id").agg(F.count("*").alias("n"))


def spine(words: Column, parts: Column) -> Column:
    """(subject, verb, object) of a sentence: the first verb, the last noun or pronoun before it, and the first one after it that no preposition precedes there."""
    n = F.size(words)
    at = F.array_position(parts, "verb").cast("int") - 1
    named = lambda p: p.isin("noun", "pronoun")
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1))
    stop = F.coalesce(F.array_min(F.filter(places, lambda i: (i > at) & (F.get(parts, i) == "preposition"))), n)
    before = F.array_max(F.filter(places, lambda i: (i < at) & named(F.get(parts, i))))
    after = F.array_min(F.filter(places, lambda i: (i > at) & (i < stop) & named(F.get(parts, i))))
    return F.when(at >= 0, F.struct(F.get(words, before).alias("subject"), F.get(words, at).alias("verb"), F.get(words, after).alias("object")))


def fact(subject: Column, relation: Column, target: Column, strength: Column | None = None) -> Column:
    """An edge of the ontology; relations go by name, unknown ones are 0; strength from 0 to 255, by default the most."""
    codes = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    held = F.least(F.lit(255), F.greatest(F.lit(0), strength)) if strength is not None else F.lit(255)
    return F.struct(subject.alias("subject"), F.coalesce(F.try_element_at(codes, F.lower(relation)), F.lit(0)).alias("relation"), target.alias("target"), held.cast("int").alias("strength"))


def read_fact(said: Column) -> Column:
    """A fact from "subject | relation | target"; null if the relation is not one that is read from text."""
    part = lambda i: F.trim(F.split_part(said, F.lit("|"), F.lit(i)))
    return F.when((F.size(F.split(said, r"\|")) == 3) & F.lower(part(2)).isin(*READ_RELATIONS), fact(part(1), part(2), part(3)))


def first_broken(sentences: DataFrame) -> DataFrame:
    """Sentences (doc_id, ordinal, high, low, words) to (doc_id, n, valid, broken): the first ordinal whose id does not fit.

    An id fits if it tells the sentence's own place, words (255 at most) and checksum, and the link of the id before it.
    """
    from pyspark.sql import Window

    told = T.uuid8_fields(F.col("high"), F.col("low"))
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = sentences.withColumn("id", told).withColumn("link", F.coalesce(F.lag(T.chain_link(F.col("high"), F.col("low"))).over(w), F.lit(0)))
    fits = (F.col("id.index") == F.col("ordinal")) & (F.col("id.words") == F.least(F.lit(255), F.size("words"))) & (F.col("id.checksum") == T.positional_checksum(F.col("words"))) & (F.col("id.chain") == F.col("link"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(fits).alias("valid"), F.min(F.when(~fits, F.col("ordinal"))).alias("broken"))


def sentence_ids(sentences: DataFrame, ts_ms: int) -> DataFrame:
    """Sentences (doc_id, ordinal, words) with ids (high, low), each linked to the one before it. A document's are chained in its row, as a fold."""
    rows = sentences.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "words"))).alias("all"))
    zero = F.struct(F.lit(0).alias("link"), F.array().cast("array<struct<ordinal:int,high:bigint,low:bigint,words:array<string>>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        chars = F.least(F.lit(4095), F.length(F.array_join(s["words"], "")))
        high, low = T.uuid8_halves(F.lit(ts_ms), a["link"], s["ordinal"], F.least(F.lit(255), F.size(s["words"])), chars, T.positional_checksum(s["words"]), F.lit(0))
        one = F.struct(s["ordinal"].cast("int").alias("ordinal"), high.alias("high"), low.alias("low"), s["words"].alias("words"))
        return F.struct(T.chain_link(high, low).alias("link"), F.array_append(a["out"], one).alias("out"))

    return rows.select("doc_id", F.explode(F.aggregate("all", zero, step, lambda a: a["out"])).alias("s")).select("doc_id", "s.*")


def note_hash(words: Column, start: Column, size: Column) -> Column:
    return F.sha2(F.array_join(F.slice(words, start + 1, size), " "), 256)


def valid_notes(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """Notes (doc_id, start, size, hash) with whether their range is inside the document's words and still holds the text they were made for."""
    words = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words"))
    inside = (F.col("start") >= 0) & (F.col("size") > 0) & (F.col("start") + F.col("size") <= F.size("words"))
    ok = F.when(F.col("words").isNotNull() & inside, note_hash(F.col("words"), F.greatest(F.lit(0), F.col("start")), F.greatest(F.lit(0), F.col("size"))) == F.col("hash")).otherwise(False)
    return notes.join(words, "doc_id", "left").select(*notes.columns, F.coalesce(ok, F.lit(False)).alias("valid"))
