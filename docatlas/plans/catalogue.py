"""Relational, search and statistics queries as SQL that Catalyst plans.

Tables stand in braces, so that one text runs on DataFrames here and as plain SQL elsewhere. Ranks always have the id
as their last key, and a limit comes before a global rank, so that no window sorts more than the limit on one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The document view: dataset and source of a document, its file's name, its pages; recency is the id.
DOC = """doc AS (SELECT doc_id, text, lang AS source_name, source AS dataset, n_chars,
  concat('DOC', lpad(CAST(doc_id AS string), 8, '0'), '.', CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'csv' WHEN 3 THEN 'mp4' ELSE 'txt' END) AS file_name,
  CAST(ceil(n_chars / 2000.0) AS int) AS page_count FROM {documents})"""
#: The text most documents of a language hold, as a query phrase of each operator below.
PHRASE = "the"

#: Cosine distance is written in each dialect; {distance} is replaced.
_TIERS = f"""WITH {DOC},
t1 AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM (SELECT doc_id FROM doc WHERE lower(file_name) LIKE '%7%' ORDER BY doc_id DESC LIMIT 2000) x),
t2 AS (SELECT doc_id, row_number() OVER (ORDER BY field_no, doc_id DESC) AS rank FROM (
  SELECT * FROM (SELECT 1 AS field_no, doc_id FROM doc WHERE lower(dataset) LIKE '%src1%' ORDER BY doc_id DESC LIMIT 1000) a
  UNION ALL SELECT * FROM (SELECT 2 AS field_no, doc_id FROM doc WHERE lower(file_name) LIKE '%pdf%' ORDER BY doc_id DESC LIMIT 1000) b) x),
t3 AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank, snippet FROM (
  SELECT doc_id, length(text) - length(replace(lower(text), ' the ', ' th ')) AS hits, substring(text, 1, 500) AS snippet FROM doc WHERE lower(text) LIKE '% the %' ORDER BY hits DESC, doc_id LIMIT 5000) x),
t4 AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM (
  SELECT vec_id, {{distance}} AS dist FROM {{embeddings}} e JOIN (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0) p ON true WHERE e.embedding IS NOT NULL ORDER BY dist, vec_id LIMIT 2000) x),
tiers AS (SELECT 1 AS tier, doc_id, rank, CAST(NULL AS string) AS snippet FROM t1 UNION ALL SELECT 2, doc_id, min(rank), NULL FROM t2 GROUP BY doc_id
  UNION ALL SELECT 3, doc_id, rank, snippet FROM t3 UNION ALL SELECT 4, doc_id, rank, NULL FROM t4)"""

SQL: dict[str, str] = {
    "rrf_three_tier": _TIERS + """
SELECT doc_id, round(sum(CAST(1 AS double) / (60 + rank + 1)), 9) AS rrf_score, count(*) AS n_tiers FROM tiers WHERE tier <> 2 GROUP BY doc_id""",
    "rrf_with_tier_columns": _TIERS + """
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS final_rank, score, t1_rank, t2_rank, t3_rank, t4_rank, best_snippet FROM (
  SELECT doc_id, round(sum(CAST(1 AS double) / (60 + rank + 1)), 9) AS score, max(CASE WHEN tier = 1 THEN rank END) AS t1_rank, max(CASE WHEN tier = 2 THEN rank END) AS t2_rank,
    max(CASE WHEN tier = 3 THEN rank END) AS t3_rank, max(CASE WHEN tier = 4 THEN rank END) AS t4_rank, max(snippet) AS best_snippet
  FROM tiers GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50000) x""",
    "filename_ilike": f"WITH {DOC} SELECT doc_id, file_name FROM doc WHERE lower(file_name) LIKE '%12%'",
    "chunk_substring": f"WITH {DOC} SELECT doc_id, n_chars FROM doc WHERE lower(text) LIKE '%and the%'",
    "metadata_fields_ranked": _TIERS + " SELECT doc_id, min(rank) AS rank FROM t2 GROUP BY doc_id",
    "fts_best_document": _TIERS + " SELECT doc_id, rank, snippet FROM t3",
    "vector_topk": "SELECT vec_id, label, round({distance}, 9) AS dist FROM {embeddings} e JOIN (SELECT embedding AS q FROM {embeddings} WHERE vec_id = 3) p ON true ORDER BY {distance}, vec_id LIMIT 100",
    "vector_best_per_label": "SELECT label, vec_id, dist FROM (SELECT label, vec_id, round({distance}, 9) AS dist, row_number() OVER (PARTITION BY label ORDER BY {distance}, vec_id) AS rn FROM {embeddings} e JOIN (SELECT embedding AS q FROM {embeddings} WHERE vec_id = 3) p ON true) x WHERE rn = 1",
    "recent_per_source": f"WITH {DOC} SELECT dataset, doc_id, rn FROM (SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY doc_id DESC) AS rn FROM doc) x WHERE rn <= 3",
    "advanced_filter": f"WITH {DOC} SELECT doc_id, file_name, page_count FROM doc WHERE dataset IN ('src1', 'src2', 'src3') AND (file_name LIKE '%.pdf' OR file_name LIKE '%.csv') AND coalesce(page_count, 0) >= 1 AND coalesce(page_count, 0) <= 4",
    "browse_page_total": f"WITH {DOC} SELECT p.doc_id, t.total FROM (SELECT doc_id FROM doc ORDER BY doc_id DESC LIMIT 50 OFFSET 100) p JOIN (SELECT count(*) AS total FROM doc) t ON true",
    "hydrate_in_order": f"WITH {DOC}, ids AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY label DESC, vec_id) AS pos FROM (SELECT * FROM {{embeddings}} ORDER BY label DESC, vec_id LIMIT 200) x) SELECT i.pos, d.doc_id, d.file_name, substring(d.text, 1, 500) AS snippet FROM ids i JOIN doc d ON d.doc_id = i.doc_id",
    "relevance_projection": f"WITH {DOC} SELECT d.doc_id, CASE WHEN d.file_name LIKE '%.pdf' THEN 'Pdf' WHEN d.file_name LIKE '%.txt' THEN 'Text' ELSE 'Image' END AS kind, round(greatest(CAST(0 AS double), 1 - x.dist), 9) AS relevance FROM doc d JOIN (SELECT vec_id, {{distance}} AS dist FROM {{embeddings}} e JOIN (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 1) p ON true) x ON x.vec_id = d.doc_id",
    "neighbour_window": "SELECT c.conv_id, c.turn, c.turn - b.turn AS turn_offset, substring(c.text, 1, 80) AS head FROM {conversations} c JOIN (SELECT conv_id, min(turn) AS turn FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id) b ON c.conv_id = b.conv_id AND c.turn BETWEEN b.turn - 1 AND b.turn + 1",
    "previous_next_turn": "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM {conversations}",
    "dataset_stats": f"WITH {DOC} SELECT coalesce(source_name, 'Unknown') AS source_name, coalesce(dataset, 'Unassigned') AS dataset, count(DISTINCT doc_id) AS docs, CAST(sum(page_count) AS bigint) AS pages, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM doc GROUP BY 1, 2",
    "dataset_stats_fanout_safe": f"WITH {DOC}, img AS (SELECT doc_id, count(*) AS images FROM {{labels}} GROUP BY doc_id) SELECT dataset, count(*) AS docs, CAST(sum(coalesce(images, 0)) AS bigint) AS images, CAST(sum(page_count) AS bigint) AS pages FROM doc LEFT JOIN img USING (doc_id) GROUP BY dataset",
    "system_stats": f"WITH {DOC} SELECT count(*) AS docs, CAST(sum(page_count) AS bigint) AS pages, count(e.vec_id) AS embedded, round(CASE WHEN count(*) > 0 THEN CAST(sum(page_count) AS double) / count(*) END, 9) AS avg_pages, max(doc_id) AS newest FROM doc LEFT JOIN {{embeddings}} e ON e.vec_id = doc.doc_id",
    "corpus_counts": "SELECT (SELECT count(*) FROM {documents}) AS docs, (SELECT count(*) FROM {pages}) AS pages, (SELECT CAST(coalesce(sum(n_chars), 0) AS bigint) FROM {documents}) AS chars",
    "metric_rows": "SELECT 'with embedding' AS metric, count(*) AS n FROM {documents} d JOIN {embeddings} e ON e.vec_id = d.doc_id UNION ALL SELECT 'without embedding', count(*) FROM {documents} d LEFT ANTI JOIN {embeddings} e ON e.vec_id = d.doc_id",
    "docs_per_dataset_zero_kept": "SELECT n.n_name, count(s.s_suppkey) AS suppliers FROM {nation} n LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "missing_embeddings": "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {embeddings} e ON e.vec_id = d.doc_id WHERE length(d.text) > 0",
    "semi_nonempty": "SELECT n_nationkey, n_name FROM {nation} n LEFT SEMI JOIN {customer} c ON c.c_nationkey = n.n_nationkey",
    "star_left_joins": "SELECT r.r_name, n.n_name, count(c.c_custkey) AS customers, coalesce(CAST(sum(CAST(c.c_acctbal AS decimal(18, 4))) AS double), 0) AS balance FROM {region} r LEFT JOIN {nation} n ON n.n_regionkey = r.r_regionkey LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2",
    "full_outer": "SELECT d.doc_id, e.vec_id FROM {documents} d FULL JOIN {embeddings} e ON e.vec_id = d.doc_id * 3",
    "revenue_by_status": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS decimal(18, 4))) AS double) AS sum_qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS decimal(18, 4))) AS double) AS revenue, count(*) AS n FROM {lineitem} WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY 1, 2",
    "top_customers": "SELECT c_custkey, c_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS decimal(18, 4))) AS double) AS revenue FROM {customer} JOIN {orders} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY revenue DESC, c_custkey LIMIT 20",
    "collection_stats": "SELECT c_custkey, coalesce(o.n, 0) AS file_count, coalesce(o.total, 0) AS total_size FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS decimal(18, 4))) AS double) AS total FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey",
    "computed_key_join": "SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, concat('Supplier:', CAST(p_partkey % 10 AS string)) AS k FROM {part}) p JOIN (SELECT s_suppkey, concat('Supplier:', CAST(s_suppkey AS string)) AS k FROM {supplier}) s ON p.k = s.k",
    "conditional_counts": "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS linked, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS bigint) AS unlinked FROM {orders} GROUP BY 1",
    "window_count_best": "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) x WHERE rn = 1",
    "dense_rank_by_prefix": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS rn, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS dr FROM {lineitem}",
    "rollup_stats": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS decimal(18, 4))) AS double) AS total FROM {orders} GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "cube_stats": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "exact_match_union": "SELECT doc_id FROM {documents} WHERE lower(text) LIKE '%for the%' UNION SELECT doc_id FROM {documents} WHERE lower(source) LIKE '%src1%'",
    "list_merge": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY pr, source) AS rn FROM (SELECT doc_id, source, 1 AS pr FROM {documents} UNION ALL SELECT doc_id, CAST(quality AS string), 2 FROM {labels}) u) x WHERE rn = 1",
    "list_xor": "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {embeddings} e ON d.doc_id = e.vec_id UNION ALL SELECT e.vec_id FROM {embeddings} e LEFT ANTI JOIN {documents} d ON e.vec_id = d.doc_id",
    "list_trim": "WITH a AS (SELECT doc_id FROM {documents} UNION ALL SELECT doc_id FROM {documents}) SELECT a.doc_id FROM a LEFT ANTI JOIN {labels} b ON a.doc_id = b.doc_id",
    "list_append": "SELECT doc_id, 'a' AS origin FROM {documents} UNION ALL SELECT b.vec_id, 'b' FROM {embeddings} b LEFT ANTI JOIN {documents} a ON b.vec_id = a.doc_id",
    "intersect_lists": "SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}",
    "insert_ignore": "SELECT min(event_id) AS event_id, user_id FROM {events} e LEFT ANTI JOIN {supplier} c ON c.s_suppkey = e.user_id GROUP BY user_id",
    "upsert_latest_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x WHERE rn = 1",
    "fuzzy_title": "SELECT p_partkey, p_name FROM {part} WHERE levenshtein(lower(p_name), 'part 12') <= 2 OR levenshtein(lower(p_type), 'type1') <= 1 OR levenshtein(lower(p_brand), 'brand#12') <= 1",
    "downloads_by_type": "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS decimal(28, 8))) AS double) AS total FROM {events} GROUP BY event_type ORDER BY n DESC",
    "first_per_group": "SELECT conv_id, min(turn) AS turn, count(*) AS turns FROM {conversations} GROUP BY conv_id",
    "mixed_direction_order": "SELECT doc_id, source, lang FROM (SELECT * FROM {documents} ORDER BY lang DESC, source ASC, doc_id LIMIT 100) x",
    "gap_islands": "SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM (SELECT user_id, event_id, ts, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10 THEN 1 ELSE 0 END AS brk FROM {events}) a) b GROUP BY 1, 2",
    "tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS decimal(28, 8))) AS double) AS total FROM {events} GROUP BY 1, 2",
    "sessionize": "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS session FROM (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < ts - INTERVAL '30' MINUTE THEN 1 ELSE 0 END AS brk FROM {events}) a) b GROUP BY 1, 2",
}

_SPARK = {"{distance}": "(1 - aggregate(zip_with(e.embedding, p.q, (x, y) -> CAST(x AS double) * y), CAST(0 AS double), (a, x) -> a + x) / (sqrt(aggregate(e.embedding, CAST(0 AS double), (a, x) -> a + CAST(x AS double) * x)) * sqrt(aggregate(p.q, CAST(0 AS double), (a, x) -> a + CAST(x AS double) * x))))"}
_DUCK = {"{distance}": "list_cosine_distance(CAST(e.embedding AS double[]), CAST(p.q AS double[]))"}


def _said(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace(k, v)
    return sql


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables of a folder; only those it names are opened."""
    used = [t for t in TABLES if f"{{{t}}}" in sql]
    return spark.sql(_said(sql, _SPARK), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def plain(sql: str) -> str:
    """The same query in plain SQL over views of the tables' names."""
    sql = _said(sql, _DUCK).replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def queries() -> dict:
    return {name: (lambda spark, sf_dir, sql=sql: run(spark, sf_dir, sql)) for name, sql in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: plain(sql) for name, sql in SQL.items()}
