"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embeddings, fingerprints, langid, minhash, mixing, packing, pii, quality, ranked, secrets, sstable, toxicity
from .common import table
from .tokens import vocabulary_path

def _crc() -> Column:
    """crc32 of the id as text, which tells held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _crc() % 4 == 2
    found = langid.detect(docs, langid.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _crc() % 5 == 0
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.domains(table(spark, sf_dir, "labels")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _crc() % 3 == 1
    found = toxicity.classify(docs, table(spark, sf_dir, "labels").where(~held), docs.where(~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_minhash_near_dedup, op3_quality_classifier, op4_document_fingerprints, op5_token_shards, op6_pii, op7_source_mixing, op8_embedding_near_dedup, op9_packing, op10_secret_scan, op11_toxicity, op12_source_divergence, op13_ranked_search)}


_LINKED = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id AS node, id AS m FROM ids UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.m)"""


def oracle_sql() -> dict[str, str]:
    """Those that plain SQL can express; the others are held against brute force in tests/llm."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shingles = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ids AS (SELECT DISTINCT doc_id AS id FROM documents), {_LINKED}
SELECT r.node AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.m) AS component_id, min(r.m) = r.node AS kept FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node"""
    vectors = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS double[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
ids AS (SELECT vec_id AS id FROM v), {_LINKED}, d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT r.node AS vec_id, CAST(coalesce(max(d.n), 0) AS bigint) AS n_links, min(r.m) AS component_id, min(r.m) = r.node AS kept FROM r LEFT JOIN d ON d.a = r.node GROUP BY r.node"""
    low = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    shares = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({low}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v) AS bigint) AS p, CAST(1 + (1000000000::hugeint * (k.n + 5)) // (v.total + 5 * v.v) AS bigint) AS q
  FROM t JOIN k ON k.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.f, 0) AS bigint) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""
    ranking = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
u AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY 1, 2),
t AS (SELECT id, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) x GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM s) + 2) / (2 * count(*) + 1))) AS bigint) AS w FROM t WHERE term IN (SELECT term FROM u) GROUP BY 1),
r AS (SELECT item_id, id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * t.n * s.n) // s.l)))) AS bigint) AS score FROM u JOIN w ON w.term = u.term JOIN t ON t.term = u.term, s GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
    return {"op2_minhash_near_dedup": shingles, "op8_embedding_near_dedup": vectors, "op12_source_divergence": shares, "op13_ranked_search": ranking}
