"""Queries over files' identifiers, fragments in reading order, extractions, grammar matches and links between results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.functions import identifiers, layout, text as T

from . import analysis, search


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _kind() -> Column:
    return F.get(F.array(*map(F.lit, ("md5", "aacid", "htid", "ia_id"))), (F.col("doc_id") % 4).cast("int"))


def _file() -> Column:
    """Every kind of file name under every kind of collection: digests, ids with a day, plain names."""
    digest = F.upper(F.md5(F.col("doc_id").cast("string").cast("binary")))
    named = F.get(F.array(F.concat(F.lit("md5_"), digest), F.concat(F.lit("aacid__files__20250610T193711Z__"), F.col("doc_id").cast("string")), F.concat(F.lit("mdp.39015"), F.col("doc_id").cast("string"))), (F.col("doc_id") % 3).cast("int"))
    return F.concat(F.lit("store/"), named, F.lit(".pdf"))


def _fragments(s: SparkSession, d: str) -> DataFrame:
    """Order lines as fragments on pages, their own size of font as height."""
    return analysis.glyphs(s, d).select("page", "no", F.concat(F.lit("w"), F.col("no").cast("string")).alias("text"), "x", "y", "width", F.col("font").alias("height"))


def _links(s: SparkSession, d: str) -> DataFrame:
    vectors = _t(s, d, "embeddings")
    shown = [r[0] for r in vectors.select("vec_id").distinct().orderBy(F.desc("vec_id")).limit(20).collect()]
    return search.relationships(shown, vectors).select("source", "target", "rank")


QUERIES = {
    "file_identifiers": lambda s, d: _t(s, d, "documents").select("doc_id", identifiers.identifier(_file(), _kind()).alias("i")).select("doc_id", F.col("i.id").alias("id"), F.col("i.kind").alias("kind"), F.col("i.md5").alias("md5")),
    "reading_order": lambda s, d: layout.page_texts(layout.read_order(_fragments(s, d))),
    "richer_extraction": lambda s, d: _t(s, d, "pages").select("page_id", layout.richer(T.tags_stripped(F.col("html")), F.col("html")).alias("bare")),
    "search_grammar_tier": lambda s, d: search.grammar_tier(search.documents(s, d)).select("doc_id", "rank", "kind", "position", "snippet"),
    "result_links": _links,
}

_RULES = [(k, p.replace("'", "''"), c) for k, p, c in search.GRAMMAR]
_BARE = "replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_N = r"len(regexp_extract_all({}, '[^ \t\n\r\f\v]+'))"

ORACLES = {
    "file_identifiers": """WITH f AS (SELECT doc_id, doc_id % 4 AS c, doc_id % 3 AS n, md5(CAST(doc_id AS varchar)) AS digest FROM documents),
k AS (SELECT *, CASE WHEN c = 1 AND n = 1 THEN 'aacid' WHEN c = 2 THEN 'htid' WHEN c = 3 THEN 'ia_id' ELSE 'md5' END AS kind, CASE n WHEN 0 THEN 'md5_' || upper(digest) WHEN 1 THEN 'aacid__files__20250610T193711Z__' || doc_id ELSE 'mdp.39015' || doc_id END AS name FROM f)
SELECT doc_id, CASE WHEN kind <> 'md5' THEN name WHEN n = 0 THEN digest END AS id, kind, CASE WHEN kind = 'md5' AND n = 0 THEN digest END AS md5 FROM k""",
    "reading_order": """WITH g AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS page, l_linenumber AS no, l_quantity * 3 AS x, CAST(l_suppkey % 30 AS double) AS y, CAST(8 + l_partkey % 5 AS double) AS h, CAST(1 + l_partkey % 7 AS double) AS w FROM lineitem),
s AS (SELECT *, CASE WHEN y - lag(y) OVER d > 2.5 THEN 1 ELSE 0 END AS step FROM g WINDOW d AS (PARTITION BY page ORDER BY y, x, no)),
b AS (SELECT *, sum(step) OVER (PARTITION BY page ORDER BY y, x, no ROWS UNBOUNDED PRECEDING) AS band FROM s),
o AS (SELECT *, lag(y) OVER a AS py, lag(x + w) OVER a AS px, row_number() OVER a AS place FROM b WINDOW a AS (PARTITION BY page ORDER BY band, x, no))
SELECT page, string_agg(CASE WHEN abs(y - py) <= 0.3 * h AND x - px > 0.15 * h THEN ' ' ELSE '' END || 'w' || no, '' ORDER BY place) AS text FROM o GROUP BY page""",
    "richer_extraction": f"SELECT page_id, CASE WHEN {_N.format('html')} > {_N.format(_BARE)} THEN html ELSE {_BARE} END AS bare FROM pages",
    "search_grammar_tier": "WITH c AS (" + " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS kind, {c} AS confidence, regexp_extract(text, '{p}') AS snippet FROM documents" for k, p, c in _RULES) + """),
b AS (SELECT doc_id, kind, confidence, snippet, strpos(text, snippet) AS position FROM c WHERE snippet <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC) = 1)
SELECT doc_id, row_number() OVER (ORDER BY confidence DESC, position, doc_id) AS rank, kind, position, snippet FROM b QUALIFY rank <= 5000""",
    "result_links": """WITH v AS (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings), q AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT 20)
SELECT q.vec_id AS source, v.vec_id AS target, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.vec_id) AS rank FROM q JOIN v ON v.vec_id <> q.vec_id QUALIFY rank <= 10""",
}
