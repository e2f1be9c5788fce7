"""A training-data pipeline over `documents`: each stage reads what the one before it wrote.

A stage keeps a document's columns apart from what it works out itself, as one struct, so that no column of the
documents can clash with one of its own. Rows are kept or dropped as they stand; repeated rows stay repeated unless
near-duplicates are dropped. Null and empty texts have no language and go in the first stage; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.llm import common, langid, minhash, mixing, packing, secrets
from docatlas.llm.tokens import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found ("und": null, empty or without letters)."""
    known = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    return langid.detect(docs, known, keep="own").where("lang_pred <> 'und'").select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies, one row of it where its row repeats; rows without an id have no place in a group and go."""
    kept = minhash.near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("id"))
    got = common.written(own.join(kept.hint("shuffle_hash"), "id"), "pipeline-kept")
    return got.where("n = 1").select("own.*").unionByName(got.where("n > 1").dropDuplicates(["id"]).select("own.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets found in a document's text; n_chars follows where there is such a column. Findings come back by document and text, so that copies of a text are in many tasks."""
    hits = secrets.scan(docs).where(F.size("findings") > 0).select(F.col("doc_id").alias("id"), "blob", "findings").dropDuplicates(["id", "blob"])
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(whole, 256)).alias("blob"))
    got = own.join(hits, own["id"].eqNullSafe(hits["id"]) & (own["blob"] == hits["blob"]), "left").select("own", "findings")
    clean = secrets.redacted(F.col("own.text").cast("string"), F.col("findings"))
    own = F.col("own").withField("text", F.when(F.col("findings").isNull(), F.col("own.text")).otherwise(clean.cast(docs.schema["text"].dataType)))
    if "n_chars" in docs.columns:
        own = own.withField("n_chars", F.when(F.col("findings").isNull(), F.col("own.n_chars")).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType))
    return got.select(own.alias("own")).select("own.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins domains that exceed their target: a document stays if its rate rounds up to a copy at least; none is repeated."""
    return mixing.mix(docs, mixing.domains(common.table(spark, sf_dir, "labels")), keep="own").where("copies > 0").select("own.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.packed(docs, vocabulary_path())


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("secret scan", secret_scan), ("source mixing", mixing_stage), ("packing", pack)]

#: Automata, fitted rates and tokens have no form in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return docs
