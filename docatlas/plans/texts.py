"""Queries over text functions, chunkers, similarity links, and batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.functions import chunks, cleaning, identifiers, text as T
from docatlas.operators import graph
from docatlas.streaming import events as E


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _of(column, *more, name: str = "documents", key: str = "doc_id"):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet").select(key, column(), *(m() for m in more))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every whole text, with its place."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return _docs(spark, d).select("doc_id", F.posexplode(words).alias("ordinal", "word"))


def _distances(spark: SparkSession, d: str) -> DataFrame:
    """Steps from each customer to one region, over customers, nations and regions as nodes."""
    customer, nation = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "nation"))
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    up = nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"))
    edges = customer.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst")).unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = customer.select(node("c", "c_custkey").alias("source"), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")).alias("target"))
    return graph.distances(pairs, edges)


def _names(spark: SparkSession, d: str) -> DataFrame:
    said = spark.read.parquet(f"{d}/conversations.parquet").withColumn("people", cleaning.people(F.col("text")))
    return said.select("conv_id", "turn", "people", cleaning.terms(F.col("text"), F.col("people")).alias("terms"))


#: A file name, the name that catalogue.DOC gives, and a volume's folder for each document.
_FILE = lambda: F.concat(F.lit("d."), F.get(F.array(*map(F.lit, ("pdf", "CBZ", "txt", "zip", "bin"))), (F.col("doc_id") % 5).cast("int")))
_NAME = lambda: F.concat(F.lit("DOC"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("."), F.get(F.array(*map(F.lit, ("pdf", "xlsx", "csv", "mp4", "txt"))), (F.col("doc_id") % 5).cast("int")))
_VOLUME = lambda: F.concat(F.get(F.array(*map(F.lit, ("39015t", "32044", "ark+=13960=", "x+"))), (F.col("doc_id") % 4).cast("int")), F.lpad(F.col("doc_id").cast("string"), 8, "0"))


def _DATED():
    """A note on each order that names its day, and often a later one, in one of nine forms."""
    day, later = F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 40)
    at = F.date_format
    forms = (
        F.concat(F.lit("on "), at(day, "MMMM d, yyyy")), F.concat(F.lit("on "), at(day, "d MMM yyyy"), F.lit(" and "), at(later, "MMM d, yyyy")), F.concat(at(day, "MMM dd yyyy"), F.lit(" or "), at(later, "d MMMM yyyy")),
        F.concat(at(day, "dd/MM/yyyy"), F.lit(" x")), F.concat(at(day, "yyyy-MM-dd"), F.lit(". "), at(later, "M-d-yyyy")), F.concat(at(day, "d"), F.lit(" . "), at(day, "M"), F.lit(" . "), at(day, "yy")),
        F.concat(F.lit("in "), at(day, "yyyy"), F.lit(" it")), F.concat(F.lit("30 Feb 1995, "), at(day, "yyyy-MM-dd")), F.lit("never"),
    )
    return F.get(F.array(*forms), F.pmod("o_orderkey", F.lit(9)).cast("int"))


QUERIES = {
    "mime_decode": _of(lambda: cleaning.mime_decoded(F.replace("text", F.lit(" "), F.lit("=20"))).alias("bare")),
    "mime_cleanup": _of(lambda: cleaning.mime_cleaned(F.replace("text", F.lit(" t"), F.lit("=20=t"))).alias("bare")),
    "glue_removed": _of(lambda: cleaning.unglued(F.replace("text", F.lit(", "), F.lit(","))).alias("bare")),
    "names_and_terms": _names,
    "ellipsis_merge": lambda spark, d: _docs(spark, d).select("doc_id", F.posexplode(chunks.with_dots_udf(T.sentences(F.col("text")))).alias("ordinal", "sentence")),
    "media_types": _of(lambda: identifiers.media_type(_FILE()).alias("media"), lambda: identifiers.content_kind(_FILE()).alias("kind")),
    "volume_ids": _of(lambda: identifiers.volume_id(_VOLUME()).alias("volume"), lambda: identifiers.page_url("https://viewer.example/pt", identifiers.volume_id(_VOLUME()), F.lit(1)).alias("url")),
    "digest_in_name": _of(lambda: identifiers.md5_in(F.concat(F.lit("scan-"), F.upper(F.md5(F.col("doc_id").cast("string").cast("binary"))), F.lit(".pdf"))).alias("digest")),
    "graph_distance": _distances,
    "word_count": _of(lambda: T.word_count(F.col("text")).cast("long").alias("words")),
    "words_only": _of(lambda: T.words_only(F.col("text")).alias("bare")),
    "collapse_blanks": _of(lambda: T.collapse_blanks(F.col("text")).alias("bare")),
    "part_slug": _of(lambda: T.slug(F.concat_ws("/", "p_name", "p_type")).alias("slug"), name="part", key="p_partkey"),
    "html_strip": _of(lambda: T.tags_stripped(F.col("html")).alias("bare"), name="pages", key="page_id"),
    "tokenise": _of(lambda: F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), name="benchmark", key="item_id"),
    "query_fingerprint": _of(lambda: T.query_hash(F.col("text"), False, False, ["src2", "src1"], []).alias("hash"), name="benchmark", key="item_id"),
    "json_props": _of(lambda: F.get_json_object("props", "$.k").try_cast("long").alias("k"), name="events", key="event_id"),
    "bit_xor_checksum": lambda spark, d: _docs(spark, d).groupBy("source").agg(F.bit_xor(F.col("n_chars")).alias("sum")),
    "vocabulary_index": lambda spark, d: _docs(spark, d).select("doc_id", F.explode(F.split(F.lower("text"), r"[ \n]")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")),
    "date_deduce": _of(lambda: T.deduced_date(_DATED()).alias("day"), name="orders", key="o_orderkey"),
    "title_cascade": _of(lambda: T.title(F.col("text"), _NAME()).alias("title")),
    "junk_flags": _of(lambda: T.is_junk(F.col("text")).alias("junk")),
    "sentence_split": lambda spark, d: _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ordinal", "sentence")),
    "fts_lexeme_and": lambda spark, d: _docs(spark, d).where(T.matches(F.col("text"), F.lit("thing with"))).select("doc_id"),
    "chunk_2000": lambda spark, d: _docs(spark, d).select("doc_id", F.posexplode(chunks.bounded_udf(T.sentences(F.col("text")))).alias("chunk", "text")),
    "chunk_sliding_350": lambda spark, d: _docs(spark, d).select("doc_id", F.posexplode(chunks.sliding_udf(F.col("text"))).alias("chunk", "text")),
    "tumbling_twin": lambda spark, d: E.windowed(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))),
    "session_window_twin": lambda spark, d: E.sessions(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))),
    "lemma_lookup": lambda spark, d: _words(spark, d).select("doc_id", "ordinal", T.lemma_forms(F.col("word")).alias("forms")),
    "dsl_fields": lambda spark, d: _words(spark, d).select("doc_id", "ordinal", T.dsl_parsed(F.col("word")).alias("t")),
}

ORACLES = {
    "mime_decode": "SELECT doc_id, array_to_string(list_transform(string_split(replace(text, ' ', '=20'), '='), lambda p, i: CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[0-9A-Fa-f]{2}') THEN concat(CASE WHEN TRY_CAST(concat('0x', substring(p, 1, 2)) AS int) IN (10, 13) THEN ' ' WHEN TRY_CAST(concat('0x', substring(p, 1, 2)) AS int) BETWEEN 32 AND 126 THEN chr(TRY_CAST(concat('0x', substring(p, 1, 2)) AS int)) ELSE '' END, substring(p, 3)) ELSE concat('=', p) END), '') AS bare FROM documents",
    "media_types": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/x-cbz' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/zip' ELSE 'application/octet-stream' END AS media, CASE doc_id % 5 WHEN 0 THEN 'book' WHEN 1 THEN 'comic' WHEN 2 THEN 'book' WHEN 3 THEN 'archive' ELSE 'unknown' END AS kind FROM documents",
    "volume_ids": "SELECT doc_id, volume, CASE WHEN volume NOT LIKE 'ark%' THEN concat('https://viewer.example/pt?id=', volume, '&seq=1') END AS url FROM (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'mdp.390150' WHEN 1 THEN 'hvd.32044' WHEN 2 THEN 'ark+=13960=' ELSE 'x.' END, lpad(CAST(doc_id AS varchar), 8, '0')) AS volume FROM documents) x",
    "digest_in_name": "SELECT doc_id, md5(CAST(doc_id AS varchar)) AS digest FROM documents",
    "graph_distance": "SELECT concat('c', c_custkey) AS source, concat('r', c_custkey % 5) AS target, CASE WHEN n_regionkey = c_custkey % 5 THEN 2 ELSE -1 END AS distance FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "word_count": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS bigint) AS words FROM documents",
    "words_only": "SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z]{2,}'), ' ') AS bare FROM documents",
    "collapse_blanks": r"SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ') AS bare FROM documents",
    "part_slug": r"SELECT p_partkey, regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(replace(lower(concat(p_name, '/', p_type)), '&', 'and'), '[ /\\]', '-', 'g'), '[:''\"?]', '', 'g'), '-+', '-', 'g'), 1, 100), '^-+|-+$', '', 'g') AS slug FROM part",
    "html_strip": "SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS bare FROM pages",
    "tokenise": r"SELECT item_id, CAST(len(regexp_extract_all(text, '<[^>]*>|[\p{P}\p{S}]|\s+|[^\s<\p{P}\p{S}]+')) AS bigint) AS n_tokens FROM benchmark",
    "query_fingerprint": "SELECT item_id, substring(sha256(concat(lower(text), '|false|false|src1,src2||')), 1, 32) AS hash FROM benchmark",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events",
    "bit_xor_checksum": "SELECT source, bit_xor(n_chars) AS sum FROM documents GROUP BY source",
    "vocabulary_index": "SELECT word, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) AS word FROM documents) x GROUP BY word",
    "sentence_split": r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([!?])', '\1' || chr(1), 'g'), '[.](\s|<|$)', '.' || chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS ss FROM documents) SELECT doc_id, i - 1 AS ordinal, ss[i] AS sentence FROM s, unnest(range(1, len(ss) + 1)) AS u(i)",
    "tumbling_twin": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS decimal(28, 8))) AS double), 4) AS total FROM events GROUP BY 1, 2",
    "session_window_twin": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events) a) b GROUP BY user_id, session",
    "title_cascade": "SELECT doc_id, CASE " + " ".join(f"WHEN strpos(lower(substring(text, 1, 2000)), '{k.lower()}') > 0 THEN '{v} - ' || f" for k, v in T.TITLE_LABELS) + " ELSE f END AS title FROM (SELECT *, 'DOC' || lpad(CAST(doc_id AS varchar), 8, '0') || '.' || CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'csv' WHEN 3 THEN 'mp4' ELSE 'txt' END AS f FROM documents) x",
    "date_deduce": r"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS date) AS x, CAST(CAST(o_orderdate AS date) + 40 AS date) AS z FROM orders),
t AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'on ' || strftime(x, '%B %-d, %Y') WHEN 1 THEN 'on ' || strftime(x, '%-d %b %Y') || ' and ' || strftime(z, '%b %-d, %Y') WHEN 2 THEN strftime(x, '%b %d %Y') || ' or ' || strftime(z, '%-d %B %Y')
  WHEN 3 THEN strftime(x, '%d/%m/%Y x') WHEN 4 THEN strftime(x, '%Y-%m-%d') || '. ' || strftime(z, '%-m-%-d-%Y') WHEN 5 THEN strftime(x, '%-d . %-m . %y') WHEN 6 THEN strftime(x, 'in %Y it') WHEN 7 THEN '30 Feb 1995, ' || strftime(x, '%Y-%m-%d') ELSE 'never' END AS h FROM o),
f AS (SELECT *, regexp_extract(h, '(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+([0-9]{1,2}),?\s+([0-9]{4})\b', ['m', 'd', 'y']) AS a,
  regexp_extract(h, '(?i)\b([0-9]{1,2})\s+((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*)\s+([0-9]{4})\b', ['d', 'm', 'y']) AS b, regexp_extract(h, '(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*)\s+([0-9]{1,2}),?\s+([0-9]{4})\b', ['m', 'd', 'y']) AS c,
  regexp_extract(h, '\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\b', ['m', 'd', 'y']) AS e, regexp_extract(h, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b') AS g, regexp_extract(h, '\b([0-9]{1,2})[^\w]{1,5}([0-9]{1,2})[^\w]{1,5}([0-9]{2,4})\b', ['u', 'v', 'w']) AS s, regexp_extract(h, '\b(?:19|20)[0-9]{2}\b') AS y FROM t),
n AS (SELECT *, TRY_CAST(s.u AS int) AS u, TRY_CAST(s.v AS int) AS v, CASE WHEN TRY_CAST(s.w AS int) >= 100 THEN TRY_CAST(s.w AS int) WHEN TRY_CAST(s.w AS int) > 30 THEN TRY_CAST(s.w AS int) + 1900 ELSE TRY_CAST(s.w AS int) + 2000 END AS w FROM f)
SELECT o_orderkey, CAST(coalesce(try_strptime(a.m || ' ' || a.d || ' ' || a.y, '%B %d %Y'), try_strptime(b.m || ' ' || b.d || ' ' || b.y, ['%B %d %Y', '%b %d %Y']), try_strptime(c.m || ' ' || c.d || ' ' || c.y, ['%B %d %Y', '%b %d %Y']),
  try_strptime(e.m || '/' || e.d || '/' || e.y, '%m/%d/%Y'), try_strptime(g, '%Y-%m-%d'), try_strptime(lpad(CAST(w AS varchar), 4, '0') || '-' || CASE WHEN u > 12 AND v <= 12 THEN v || '-' || u ELSE u || '-' || v END, '%Y-%m-%d'), try_strptime(y, '%Y')) AS date) AS day FROM n""",
}
