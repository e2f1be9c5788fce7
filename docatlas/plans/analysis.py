"""Statistics of books and libraries, layout windows, range joins, catalogue look-ups and work queues, each with SQL of its own as oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docatlas.functions import prose, text as T
from docatlas.indexes import home
from docatlas.operators import fuzzy, ledger, lexicon, merge, ranges, wordlists
from docatlas.sources import keysets
from docatlas.streaming import events as E

from . import search

_TITLES = [(k.lower(), v) for k, v in T.TITLE_LABELS]


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def tokens(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, ordinal, word) of every whole text, by blanks."""
    return _tokens(_t(s, d, "documents"))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \n]"), lambda w: w != "")).alias("ordinal", "word"))


#: Parts over which a word is dealt out in a look-up.
SALT = 16


def occurrences(words: DataFrame, most: int = 1000) -> DataFrame:
    """Vocabulary: count, first and last place of each word (doc_id, ordinal, word), and its first places in order, at most `most`.

    A frequent word is never sorted in one task: of each batch of rows only its count and `most` places of it go on.
    """
    return wordlists.merged(wordlists.placed(words, most), most)


def totals(words: DataFrame, known: DataFrame, sentences: DataFrame) -> DataFrame:
    """Of each document: tokens, content words, different ones, those a lexicon (word) knows and those it does not, their share in percent, sentences (doc_id, sentences), and content words a sentence.

    Words are counted by document first and looked up once each, so that a frequent word is one row of the look-up.
    """
    bare = F.nullif(F.regexp_replace(F.lower("word"), r"^[^\p{L}]+|[^\p{L}]+$", ""), F.lit(""))
    counts = words.groupBy("doc_id", bare.alias("bare")).agg(F.count("*").alias("n"))
    hit = counts.where("bare is not null").select("bare").distinct().join(known.select(F.col("word").alias("bare")).distinct(), "bare", "left_semi").withColumn("hit", F.lit(1))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(hit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["bare", "salt"], "left")
    content = F.when(F.col("bare").isNotNull(), F.col("n")).otherwise(0)
    sums = salted.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.sum(content).alias("content"), F.count("bare").alias("different"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("defined"))
    return _shares(sums.join(sentences, "doc_id", "left"))


def _shares(sums: DataFrame) -> DataFrame:
    told = sums.withColumn("undefined", F.col("content") - F.col("defined")).withColumn("sentences", F.coalesce("sentences", F.lit(0)).cast("long"))
    share = lambda a, b, by=1.0: F.round(F.when(F.col(b) > 0, by * F.col(a) / F.col(b)), 6)
    return told.withColumn("coverage", share("defined", "content", 100.0)).withColumn("sentence_length", share("content", "sentences"))


def totals_of_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """totals() of whole texts (doc_id, text), each counted in its row; only lists of words are shuffled, for the look-up. A table that repeats ids takes the way of totals()."""
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return totals(_tokens(docs), known, docs.select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences")))
    edges = r"(?<![^ \n])[^\p{L} \n]+|(?<=\p{L})[^\p{L} \n]++(?![^ \n])"  # of each word what stands before its first or after its last letter
    bare = docs.select("doc_id", "text", F.regexp_replace(F.lower("text"), edges, "").alias("bare"))
    count = lambda c: F.regexp_count(c, F.lit(r"[^ \n]+")).cast("long")
    different = F.size(F.array_remove(F.array_distinct(F.split("bare", r"[ \n]")), "")).cast("long")
    sums = bare.select("doc_id", count("text").alias("tokens"), count("bare").alias("content"), different.alias("different"), F.size(T.sentences(F.col("text"))).alias("sentences")).where("tokens > 0")
    hits = wordlists.lists(bare.select("doc_id", F.col("bare").alias("text"))).join(known.select("word").distinct(), "word", "left_semi")
    defined = hits.select(F.inline("held")).groupBy("doc_id").agg(F.sum("n").alias("defined"))
    return _shares(sums.join(defined, "doc_id", "left").select("doc_id", "tokens", "content", "different", F.coalesce("defined", F.lit(0)).cast("long").alias("defined"), "sentences"))


def sentence_stats(docs: DataFrame) -> DataFrame:
    """Of each line: kind by its last mark, tokens, content words and their mean length."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).where("line <> ''")
    words = F.filter(F.transform(F.filter(F.split("line", " "), lambda w: w != ""), lambda w: F.regexp_replace(w, r"[^\p{L}]+", "")), lambda w: w != "")
    kind = F.when(F.col("line").endswith("?"), "question").when(F.col("line").endswith("!"), "exclamation").when(F.col("line").endswith("."), "statement").otherwise("fragment")
    mean = F.round(F.length(F.array_join(words, "")) / F.nullif(F.size(words), F.lit(0)), 6)
    return rows.select("doc_id", "ordinal", kind.alias("kind"), F.size(F.filter(F.split("line", " "), lambda w: w != "")).alias("tokens"), F.size(words).alias("content"), mean.alias("mean_length"))


def contexts(docs: DataFrame, key: str, reach: int = 5) -> DataFrame:
    """Every word with the words up to `reach` places around it."""
    ws = F.split("text", " ")
    places = F.transform(ws, lambda w, i: F.struct(i.alias("ordinal"), w.alias("word"), F.array_join(F.slice(ws, F.greatest(F.lit(1), i + 1 - reach), reach + 1 + F.least(F.lit(reach), i)), " ").alias("context")))
    return docs.select(key, F.explode(places).alias("x")).select(key, "x.*")


def _glyphs(lines: DataFrame, *more) -> DataFrame:
    return lines.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), (F.col("l_quantity") * 3).alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"), (8 + F.col("l_partkey") % 5).cast("double").alias("font"), (1 + F.col("l_partkey") % 7).cast("double").alias("width"), *more)


def layout(s: SparkSession, d: str) -> DataFrame:
    """Tokens on pages: order lines as glyphs with place, width and size of font."""
    return _glyphs(_t(s, d, "lineitem"))


def glyphs(s: SparkSession, d: str) -> DataFrame:
    """layout() with one token a place of a page: the first row of the table as it stands, by file and row, however it is read."""
    rows = _glyphs(_t(s, d, "lineitem"), F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    return rows.groupBy("page", "no").agg(F.min_by(F.struct("x", "y", "font", "width"), "at").alias("t")).select("page", "no", "t.*")


def formatting(glyphs: DataFrame) -> DataFrame:
    """What stands between a token and the one before it on its page: a paragraph (more than 1.4 sizes of font apart), a line (0.5), a space (a gap of more than 0.2), nothing."""
    w = Window.partitionBy("page").orderBy("no", "x", "y", "font", "width")
    down = F.abs(F.col("y") - F.lag("y").over(w))
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    kind = F.when(down.isNull(), "start").when(down > 1.4 * F.col("font"), "paragraph").when(down > 0.5 * F.col("font"), "line").when(gap > 0.2 * F.col("font"), "space").otherwise("none")
    return glyphs.select("page", "no", kind.alias("before"))


def local_width(glyphs: DataFrame) -> DataFrame:
    """Mean width of the tokens from five before to four after whose font differs by at most a fifth."""
    w = Window.partitionBy("page").orderBy("no", "x", "y", "font", "width").rowsBetween(-5, 4)
    near = F.filter(F.collect_list(F.struct("font", "width")).over(w), lambda x: F.abs(x["font"] - F.col("font")) <= 0.2 * F.col("font"))
    return glyphs.select("page", "no", near.alias("near")).select("page", "no", F.round(F.aggregate("near", F.lit(0.0), lambda a, x: a + x["width"]) / F.size("near"), 6).alias("mean_width"))


def covered(words: DataFrame, notes: DataFrame) -> DataFrame:
    """Words that a note (doc_id, start, size) covers: start <= ordinal < start + size. A note's places are few, so they are listed and joined by equality."""
    places = notes.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("ordinal"))
    return words.join(places, ["doc_id", "ordinal"])


def sync_status(pairs: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(name, source_rows, target_rows, last_id, pct) of tables that are copied; no percentage where the source is empty."""
    out = None
    for name, source, _, target, key in pairs:
        row = source.agg(F.count("*").alias("source_rows")).join(target.agg(F.count("*").alias("target_rows"), F.max(key).alias("last_id"))).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("pct", F.round(F.when(F.col("source_rows") > 0, 100.0 * F.col("target_rows") / F.col("source_rows")), 6))


def catalogue_search(parts: DataFrame, needle: str, linked: bool) -> DataFrame:
    """Parts whose name, type or brand hold the needle, with what links to them, by name."""
    said = [F.contains(F.lower(c), F.lit(needle.lower())) for c in ("p_name", "p_type", "p_brand")]
    got = parts.where(said[0] | said[1] | said[2])
    return got.where("linked > 0") if linked else got


#: Words that carry no content.
STOPS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def scanned(html: DataFrame, key: str) -> DataFrame:
    """Marked-up texts (key, html) to their tokens, with class, sentence, page and chapter.

    Classes, the first that holds: tag, space, punctuation, stop word, number, proper noun (capitalised and not first in
    its sentence), content. Pages and chapters are those of the last marker before a token.
    """
    parts = F.regexp_extract_all("html", F.lit(r"(<[^>]*>|[\p{L}\p{N}]+(?:['’][\p{L}]+)*|\s+|.)"), F.lit(1))
    rows = html.select(key, F.posexplode(parts).alias("ordinal", "token"))
    w = Window.partitionBy(key).orderBy("ordinal")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    tag = F.col("token").rlike("^<[^>]+>$")
    rows = rows.select("*", F.last(F.when(tag, prose.page_marker(F.col("token"))), True).over(so_far).alias("page"), F.last(F.when(tag, prose.chapter_marker(F.col("token"))), True).over(so_far).alias("chapter"))
    ends = F.when(F.col("token").rlike("^[.?!]$") | (tag & F.col("token").rlike(r"(?i)^<(?:br|/p|/h|/div|/li|/tr|/bl|/ar|/se)")), 1).otherwise(0)
    rows = rows.withColumn("sentence", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    word = F.col("token").rlike(r"^[\p{L}\p{N}]")
    first = F.coalesce(F.sum(F.when(word, 1).otherwise(0)).over(Window.partitionBy(key, "sentence").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    kind = F.when(tag, "tag").when(F.trim(F.translate("token", "\n\r\t", "   ")) == "", "space").when(~word, "punctuation").when(F.lower("token").isin(*STOPS), "stop").when(F.col("token").rlike("^[0-9]+$"), "number").when(F.col("token").rlike(r"^\p{Lu}") & ~first, "proper").otherwise("content")
    return rows.select(key, "ordinal", "token", kind.alias("kind"), "sentence", "page", "chapter")


def _interval_boxes(s: SparkSession, d: str, mod: int, lo: float, hi: float) -> DataFrame:
    return _t(s, d, "events").where("event_type = 'error'").select((F.col("event_id") % mod).alias("page"), (F.col("value") + lo).alias("lo"), (F.col("value") + hi).alias("hi"), "event_id")


def _interval_overlap(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("event_id", "value", (F.col("event_id") % 50).alias("page"))
    pairs = ranges.overlapping(e, _interval_boxes(s, d, 50, 0, 5), ["page"], (F.col("value") - 2, F.col("value") + 2), (F.col("lo"), F.col("hi")), 5.0)
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count("*").alias("boxes"), F.min("r.event_id").alias("first_box"))


def _points(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("event_id", "value", (F.col("event_id") % 20).alias("page"))
    return ranges.outside(e, _interval_boxes(s, d, 20, -2, 2), ["page"], F.col("value"), (F.col("lo"), F.col("hi")), 4.0).select("event_id")


def _library(s: SparkSession, d: str) -> DataFrame:
    docs = search.documents(s, d)
    pdf = F.col("file_name").endswith(".pdf")
    stats = docs.agg(F.count("*").alias("books"), F.count_if(pdf).alias("pdfs"), F.sum(F.when(pdf, F.coalesce("page_count", F.lit(0))).otherwise(0)).alias("pdf_pages"))
    return stats.join(docs.orderBy(F.desc("doc_id")).limit(10).select("doc_id"))


def _queue(s: SparkSession, d: str) -> DataFrame:
    """Orders to be worked on: pending, or finished and not yet shipped."""
    o, done = _t(s, d, "orders"), _t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return o.where("o_orderstatus = 'P'").select("o_orderkey").union(o.where("o_orderstatus = 'F'").join(done, "o_orderkey", "left_anti").select("o_orderkey"))


def _projection(s: SparkSession, d: str) -> DataFrame:
    """A result's row: paths, folders by fallback, text, score, date, pages, the first image of each kind, source, names, terms and address."""
    docs, pages = search.documents(s, d), _t(s, d, "pages")
    images = pages.groupBy((F.col("page_id") % 1000).alias("doc_id")).agg(F.min(F.when(F.col("page_id") % 2 == 0, F.col("url"))).alias("thumb"), F.min(F.when(F.col("page_id") % 2 == 1, F.col("url"))).alias("full_image"))
    folder = F.coalesce(F.when(F.col("file_name").endswith(".mp4"), F.concat(F.lit("/images/"), "dataset")), F.concat(F.lit("/pdf/"), "dataset"))
    return docs.join(images, "doc_id", "left").select("doc_id", "file_name", F.concat_ws("/", folder, "file_name").alias("file_path"), folder.alias("folder"), F.substring("text", 1, 200).alias("text"), F.lit(1.0).alias("score"), F.col("deduced").cast("string").alias("deduced"), "page_count", "thumb", "full_image", F.get("names", F.lit(1)).alias("source"), "dataset", F.array_join("names", ",").alias("names"), F.array_join("terms", ",").alias("terms"), F.concat_ws(" ", "title", "file_name").alias("metadata"), F.concat(F.lit("https://files.example/"), F.replace(F.url_encode("file_name"), F.lit("+"), F.lit("%20"))).alias("url"))


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """Labels brought up to date by a batch made of the embeddings' labels: known ids keep their toxic column, new ones come in."""
    old = _t(s, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"), F.max("toxic").cast("long").alias("toxic"))
    new = _t(s, d, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.max("label").cast("long").alias("quality")).withColumn("toxic", F.lit(None).cast("long"))
    return merge.upsert(old, new, ["doc_id"], only=["quality"])


def _fuzzy(s: SparkSession, d: str) -> DataFrame:
    """Each 50th part asked for by its name without the third letter, and its type."""
    part = _t(s, d, "part")
    typed = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1 << 30), F.lit(" "), F.col("p_type"))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), typed.alias("text"))
    return fuzzy.search(*fuzzy.index(part, "p_partkey", ["p_name", "p_type"]), asked, 5)


def _stored(s: SparkSession, d: str, name: str) -> DataFrame:
    """Documents in a store, with their lines as sentences, after a second commit that gives each third one two more lines."""
    store = ledger.Ledger(s, f"{home.shared(s)}/ledger-{uuid.uuid4().hex}", "doc_key string, title string")
    docs = _t(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("doc_key"), F.substring("text", 1, 60).alias("title"), F.split("text", "\n").alias("said"), F.ceil(F.col("n_chars") / 1000).cast("int").alias("p"))
    for rows in (docs, docs.where("doc_id % 3 = 0").withColumn("said", F.concat("said", F.array(F.lit("one more"), F.lit("and another"))))):
        store.write(documents=rows.select("doc_key", "title"), sentences=ledger.sentences(rows, F.col("said"), F.col("p")), pages=ledger.pages(rows, F.col("said"), F.col("p"), F.col("title")))
    return store.read(name)


def _keys(s: SparkSession, d: str) -> DataFrame:
    """What a store knows of files that are asked for: by dataset and name, by the only one of a name, not at all."""
    docs = _t(s, d, "documents").select("doc_id")
    kept = docs.where("doc_id % 3 <> 0 or doc_id % 6 = 0").select(F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("dataset"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_name"), "doc_id")
    known = kept.select("dataset", "file_name", F.concat_ws(":", "dataset", F.col("doc_id").cast("string")).alias("doc_key"))
    asked = docs.select(F.concat(F.lit("/data/f"), F.col("doc_id").cast("string")).alias("file_path"), F.lit("a").alias("dataset"))
    return ledger.found(known, asked).select(F.substring("file_path", 8, 30).cast("long").alias("doc_id"), F.col("doc_key").alias("known"))


def _copied(s: SparkSession, d: str) -> DataFrame:
    """Orders as texts, some without a key and some with a cell that is no number, copied by ranges of the key."""
    o = _t(s, d, "orders")
    said = o.select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey").cast("string")).alias("o_orderkey"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"), "o_orderpriority", F.col("o_orderkey").alias("at"))
    path = f"{home.shared(s)}/copied-{uuid.uuid4().hex}"
    schema = "o_orderkey long, o_custkey long, o_orderpriority string"
    keysets.copied(s, lambda c: said.where(c).drop("at"), "at", schema, keysets.ranges(o.withColumnRenamed("o_orderkey", "at"), "at", 4), path, ["o_orderkey"])
    return keysets.rows(s, path, schema)


def _lemma_hits(s: SparkSession, d: str) -> DataFrame:
    """How many words of each document a lexicon knows, by their letters. Words are looked up by lists, so that a frequent one is few rows."""
    letters = _t(s, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\p{L} \n]+", "").alias("text"))
    known = _t(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).distinct().withColumn("concept", F.xxhash64("word"))
    return lexicon.looked_up(wordlists.lists(letters), known).where("concept is not null").select(F.inline("held")).groupBy("doc_id").agg(F.sum("n").alias("n"))


QUERIES = {
    "dedupe_ttl": lambda s, d: E.kept_within(_t(s, d, "events"), ["user_id", "event_type"]).select("event_id", "user_id"),
    "interval_overlap": _interval_overlap,
    "point_in_interval_anti": _points,
    "title_keyword": lambda s, d: search.documents(s, d).select("doc_id", T.title(F.col("text"), F.col("file_name")).alias("title")),
    "vocabulary_places": lambda s, d: wordlists.merged(wordlists.places(_t(s, d, "documents"), 20), 20).select("word", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.ordinal").alias("first_place"), F.col("last.doc_id").alias("last_doc"), F.col("last.ordinal").alias("last_place"), F.transform("places", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["ordinal"].cast("string"))).alias("places")),
    "book_totals": lambda s, d: totals_of_texts(_t(s, d, "documents"), _t(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))),
    "fuzzy_catalogue": _fuzzy,
    "store_sentences": lambda s, d: _stored(s, d, "sentences").select("doc_key", "ordinal", "page", "words"),
    "store_pages": lambda s, d: _stored(s, d, "pages").select("doc_key", "page", "first", "last", F.length("html").cast("long").alias("html")),
    "store_keys": _keys,
    "copied_orders": _copied,
    "sentence_stats": lambda s, d: sentence_stats(_t(s, d, "documents")),
    "word_contexts": lambda s, d: contexts(_t(s, d, "benchmark"), "item_id"),
    "layout_formatting": lambda s, d: formatting(layout(s, d)),
    "layout_width": lambda s, d: local_width(layout(s, d)),
    "annotated_words": lambda s, d: covered(tokens(s, d), _t(s, d, "labels").select("doc_id", (F.col("doc_id") % 40).cast("int").alias("start"), F.lit(4).alias("size"))).select("doc_id", "ordinal", "word"),
    "book_scan": lambda s, d: scanned(_t(s, d, "pages"), "page_id").groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("sentence").alias("sentences")),
    "lemma_hits": _lemma_hits,
    "table_sync": lambda s, d: sync_status([("labels", _t(s, d, "documents"), "doc_id", _t(s, d, "labels"), "doc_id"), ("embeddings", _t(s, d, "documents"), "doc_id", _t(s, d, "embeddings"), "vec_id")]),
    "library_stats": _library,
    "work_queue": _queue,
    "catalogue_search": lambda s, d: catalogue_search(_t(s, d, "part").join(_t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("linked")), "p_partkey", "left").fillna(0, ["linked"]), "small", True).select("p_partkey", "p_name", "linked"),
    "code_join": lambda s, d: _t(s, d, "customer").select("c_custkey", F.substring_index("c_name", "#", -1).cast("long").alias("code")).join(_t(s, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_name"), "code").select("c_custkey", "s_name"),
    "group_sizes": lambda s, d: search.documents(s, d).groupBy(F.regexp_extract("file_name", r"\.([a-z0-9]+)$", 1).alias("kind")).agg(F.count("*").alias("files"), F.round(F.sum(F.length("text")) / float(1 << 20), 2).alias("mb")),
    "catalogue_point": lambda s, d: _t(s, d, "orders").join(_t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("o_orderkey", "c_name"),
    "result_rows": _projection,
    "flattened_names": lambda s, d: search.documents(s, d).select("doc_id", F.explode("names").alias("name")).where("name is not null"),
    "known_union": lambda s, d: search.documents(s, d).select(F.explode("names").alias("name")).union(_t(s, d, "nation").select("n_name")).where("name is not null").distinct(),
    "unfinished": lambda s, d: _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels").select("doc_id"), "doc_id", "left_anti"),
    "latest_of_kind": lambda s, d: _t(s, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
    "code_point_order": lambda s, d: _t(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct().orderBy("word").limit(500),
    "natural_order": lambda s, d: _t(s, d, "supplier").orderBy(T.natural_key(F.col("s_name"))).limit(300).select("s_name"),
    "capped_ids": lambda s, d: search.documents(s, d).select("doc_id").orderBy(F.desc("doc_id")).limit(50_000).join(_t(s, d, "documents").agg(F.count("*").alias("total"))),
    "trusted_facets": lambda s, d: _t(s, d, "events").where("value >= 200 OR event_type IN ('error', 'view')").groupBy("event_type").agg(F.count("*").alias("n")),
    "upsert_only": _upserted,
    "sliding_windows": lambda s, d: E.windowed(_t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours", "1 hour").select("start", "event_type", "n"),
}

_TOK = r"t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS ordinal FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]'), lambda w: w <> '') AS ws FROM documents) x)"
_GLYPHS = "g AS (SELECT l_orderkey AS page, l_linenumber AS no, l_quantity * 3 AS x, CAST(l_suppkey % 30 AS double) AS y, CAST(8 + l_partkey % 5 AS double) AS font, CAST(1 + l_partkey % 7 AS double) AS width FROM lineitem)"
_BOOKS = "WITH v AS (SELECT CAST(doc_id AS varchar) AS k, substring(text, 1, 60) AS title, CAST(ceil(n_chars / 1000.0) AS int) AS p, list_concat(string_split(text, chr(10)), CASE WHEN doc_id % 3 = 0 THEN ['one more', 'and another'] ELSE [] END) AS ls FROM documents)"

ORACLES = {
    "dedupe_ttl": "WITH RECURSIVE k AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2 UNION ALL SELECT k.user_id, k.event_type, min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 30 MINUTE GROUP BY 1, 2) SELECT min(e.event_id) AS event_id, e.user_id FROM events e JOIN k ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts = k.ts GROUP BY e.user_id, e.event_type, e.ts",
    "interval_overlap": "SELECT e.event_id, count(*) AS boxes, min(b.event_id) AS first_box FROM events e JOIN events b ON b.event_type = 'error' AND e.event_id % 50 = b.event_id % 50 AND e.value - 2 <= b.value + 5 AND e.value + 2 >= b.value GROUP BY e.event_id",
    "point_in_interval_anti": "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND e.event_id % 20 = b.event_id % 20 AND e.value >= b.value - 2 AND e.value <= b.value + 2)",
    "title_keyword": search._D + " SELECT doc_id, CASE " + " ".join(f"WHEN strpos(lower(substring(text, 1, 2000)), '{k}') > 0 THEN '{v} - ' || file_name" for k, v in _TITLES) + " ELSE file_name END AS title FROM d",
    "vocabulary_places": f"WITH {_TOK} SELECT lower(word) AS word, count(*) AS n, min(doc_id) AS first_doc, first(ordinal ORDER BY doc_id, ordinal) AS first_place, max(doc_id) AS last_doc, first(ordinal ORDER BY doc_id DESC, ordinal DESC) AS last_place, list(doc_id || ':' || ordinal ORDER BY doc_id, ordinal)[1:20] AS places FROM t GROUP BY 1",
    "book_totals": rf"""WITH {_TOK}, k AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{{L}}]+')) AS w FROM benchmark), b AS (SELECT doc_id, nullif(regexp_replace(lower(word), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g'), '') AS bare FROM t),
x AS (SELECT doc_id, count(*) AS tokens, count(bare) AS content, count(DISTINCT bare) AS different, count(k.w) AS defined FROM b LEFT JOIN k ON k.w = bare GROUP BY doc_id),
y AS (SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([!?])', '\1' || chr(1), 'g'), '[.](\s|<|$)', '.' || chr(1) || '\1', 'g'), chr(1)), lambda z: trim(z, ' ' || chr(9) || chr(13) || chr(10))), lambda z: z <> '')) AS sentences FROM documents)
SELECT x.*, content - defined AS undefined, sentences, round(CASE WHEN content > 0 THEN 100.0 * defined / content END, 6) AS coverage, round(CASE WHEN sentences > 0 THEN content / sentences END, 6) AS sentence_length FROM x JOIN y ON y.doc_id = x.doc_id""",
    "fuzzy_catalogue": r"""WITH q AS (SELECT p_partkey AS query_id, list_filter(string_split_regex(lower(substring(p_name, 1, 2) || substring(p_name, 4) || ' ' || p_type), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM part WHERE p_partkey % 50 = 0),
a AS (SELECT DISTINCT query_id, unnest(ws) AS asked FROM q),
f AS (SELECT p_partkey AS key, 'p_name' AS field, unnest(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM part UNION ALL SELECT p_partkey, 'p_type', unnest(list_filter(string_split_regex(lower(p_type), '[^\p{L}\p{N}]+'), lambda w: w <> '')) FROM part),
n AS (SELECT asked, word, 1 - levenshtein(asked, word) / length(asked) AS worth FROM (SELECT DISTINCT asked FROM a) x, (SELECT DISTINCT word FROM f) y WHERE levenshtein(asked, word) <= CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END),
h AS (SELECT query_id, key, field, a.asked, max(worth) AS worth FROM a JOIN n ON n.asked = a.asked JOIN f ON f.word = n.word GROUP BY ALL),
s AS (SELECT query_id, key, field, round(sum(worth), 6) AS score FROM h GROUP BY ALL),
b AS (SELECT query_id, key, first(field ORDER BY score DESC, field) AS field, max(score) AS score FROM s GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, key, field, score FROM b QUALIFY rank <= 5""",
    "store_sentences": _BOOKS + " SELECT k AS doc_key, i AS ordinal, CAST(CASE WHEN p > 0 THEN least((i - 1) // greatest(1, len(ls) // p) + 1, p) ELSE 1 END AS int) AS page, len(list_filter(string_split(ls[i], ' '), lambda w: w <> '')) AS words FROM v, unnest(range(1, len(ls) + 1)) AS u(i) WHERE trim(ls[i], ' ') <> ''",
    "store_pages": _BOOKS + " SELECT k AS doc_key, CAST(g AS int) AS page, CAST((g - 1) * greatest(1, len(ls) // p) + 1 AS int) AS first, CAST(least(g * greatest(1, len(ls) // p), len(ls)) AS int) AS last, CASE WHEN g = 1 THEN length(title) END AS html FROM v, unnest(range(1, p + 1)) AS w(g)",
    "store_keys": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN NULL ELSE concat(CASE doc_id % 3 WHEN 0 THEN 'a' ELSE 'b' END, ':', doc_id) END AS known FROM documents",
    "copied_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0",
    "sentence_stats": r"WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ordinal FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x), w AS (SELECT *, list_filter(list_transform(list_filter(string_split(line, ' '), lambda w: w <> ''), lambda w: regexp_replace(w, '[^\p{L}]+', '', 'g')), lambda w: w <> '') AS ws FROM l WHERE line <> '') SELECT doc_id, ordinal, CASE right(line, 1) WHEN '?' THEN 'question' WHEN '!' THEN 'exclamation' WHEN '.' THEN 'statement' ELSE 'fragment' END AS kind, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS tokens, len(ws) AS content, round(len(array_to_string(ws, '')) / nullif(len(ws), 0), 6) AS mean_length FROM w",
    "word_contexts": "SELECT item_id, i - 1 AS ordinal, ws[i] AS word, array_to_string(ws[greatest(1, i - 5) : i + 5], ' ') AS context FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark) x, unnest(range(1, len(ws) + 1)) AS u(i)",
    "layout_formatting": f"WITH {_GLYPHS}, p AS (SELECT *, lag(y) OVER w AS py, lag(x + width) OVER w AS px FROM g WINDOW w AS (PARTITION BY page ORDER BY no, x, y, font, width)) SELECT page, no, CASE WHEN py IS NULL THEN 'start' WHEN abs(y - py) > 1.4 * font THEN 'paragraph' WHEN abs(y - py) > 0.5 * font THEN 'line' WHEN x - px > 0.2 * font THEN 'space' ELSE 'none' END AS before FROM p",
    "layout_width": f"WITH {_GLYPHS}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY no, x, y, font, width) AS i FROM g) SELECT a.page, a.no, round(avg(b.width), 6) AS mean_width FROM r a JOIN r b ON a.page = b.page AND b.i BETWEEN a.i - 5 AND a.i + 4 AND abs(b.font - a.font) <= 0.2 * a.font GROUP BY a.page, a.no, a.i",
    "annotated_words": f"WITH {_TOK} SELECT t.doc_id, ordinal, word FROM t JOIN labels l ON l.doc_id = t.doc_id AND ordinal >= l.doc_id % 40 AND ordinal < l.doc_id % 40 + 4",
    "table_sync": "SELECT 'labels' AS name, (SELECT count(*) FROM documents) AS source_rows, count(*) AS target_rows, max(doc_id) AS last_id, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM labels UNION ALL SELECT 'embeddings', (SELECT count(*) FROM documents), count(*), max(vec_id), round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) FROM embeddings",
    "library_stats": "SELECT s.*, r.doc_id FROM (SELECT count(*) AS books, count(*) FILTER (doc_id % 5 = 0) AS pdfs, CAST(coalesce(sum(ceil(n_chars / 2000.0)) FILTER (doc_id % 5 = 0), 0) AS bigint) AS pdf_pages FROM documents) s, (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10) r",
    "work_queue": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))",
    "catalogue_search": "SELECT p_partkey, p_name, count(*) AS linked FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_name ILIKE '%small%' OR p_type ILIKE '%small%' OR p_brand ILIKE '%small%' GROUP BY 1, 2",
    "code_join": "SELECT c_custkey, s_name FROM customer JOIN supplier ON TRY_CAST(string_split(c_name, '#')[-1] AS bigint) = s_suppkey",
    "group_sizes": search._D + " SELECT string_split(file_name, '.')[2] AS kind, count(*) AS files, round(sum(length(text)) / 1048576.0, 2) AS mb FROM d GROUP BY 1",
    "catalogue_point": "SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS c_name FROM orders",
    "result_rows": search._D + ", i AS (SELECT page_id % 1000 AS doc_id, min(url) FILTER (page_id % 2 = 0) AS thumb, min(url) FILTER (page_id % 2 = 1) AS full_image FROM pages GROUP BY 1), p AS (SELECT *, CASE WHEN file_name LIKE '%.mp4' THEN '/images/' ELSE '/pdf/' END || dataset AS folder FROM d) SELECT p.doc_id, file_name, folder || '/' || file_name AS file_path, folder, substring(p.text, 1, 200) AS text, CAST(1 AS double) AS score, CAST(deduced AS varchar) AS deduced, page_count, thumb, full_image, lang AS source, dataset, dataset || ',' || lang AS names, replace(array_to_string(list_filter(string_split_regex(lower(p.text), '[^\\p{L}]+'), lambda w: len(w) > 4)[1:3], ','), ' ', ',') AS terms, title || ' ' || file_name AS metadata, 'https://files.example/' || file_name AS url FROM p JOIN documents USING (doc_id) LEFT JOIN i USING (doc_id)",
    "flattened_names": "SELECT doc_id, source AS name FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL",
    "known_union": "SELECT source AS name FROM documents WHERE source IS NOT NULL UNION SELECT lang FROM documents WHERE lang IS NOT NULL UNION SELECT n_name FROM nation WHERE n_name IS NOT NULL",
    "unfinished": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "latest_of_kind": "SELECT event_type, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id FROM events GROUP BY 1",
    "code_point_order": "SELECT word FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) x ORDER BY encode(word) LIMIT 500",
    "natural_order": "SELECT s_name FROM supplier ORDER BY TRY_CAST(string_split(s_name, '#')[2] AS bigint) LIMIT 300",
    "capped_ids": "SELECT doc_id, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id DESC LIMIT 50000",
    "trusted_facets": "SELECT event_type, count(*) AS n FROM events WHERE value >= 200 OR event_type IN ('error', 'view') GROUP BY 1",
    "upsert_only": "WITH o AS (SELECT doc_id, CAST(max(quality) AS bigint) AS quality, CAST(max(toxic) AS bigint) AS toxic FROM labels GROUP BY 1), n AS (SELECT vec_id AS doc_id, CAST(max(label) AS bigint) AS quality FROM embeddings GROUP BY 1) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.quality ELSE n.quality END AS quality, toxic FROM o FULL JOIN n ON o.doc_id = n.doc_id",
    "sliding_windows": "SELECT h + INTERVAL (k) HOUR AS start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM events) x, (VALUES (0), (-1)) AS v(k) GROUP BY 1, 2",
}
