"""Queries through the stored vector index. Vectors of four in a row are taken for the chunks of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.indexes import home
from docatlas.indexes import vectors as V

from . import search


def index(s: SparkSession, d: str) -> V.Vectors:
    def build(path: str) -> None:
        V.build(s.read.parquet(f"{d}/embeddings.parquet").select(F.expr("vec_id div 4").alias("doc_id"), (F.col("vec_id") % 4).alias("chunk"), "embedding"), path)

    return V.Vectors(s, home.once(s, "vectors", f"{d}/embeddings.parquet", build))


def _of(s: SparkSession, d: str, condition: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").where(condition).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_search(s: SparkSession, d: str) -> DataFrame:
    """Chunks of filtered documents by distance; a document may come more than once."""
    only = search.Stored(s, d).documents.where(search.Filters(datasets=("src1", "src2", "src3", "src4", "src5", "src6", "src7")).condition()).select("doc_id")
    return index(s, d).nearest(_of(s, d, "vec_id = 3"), 20, only=only).select("rank", "doc_id", "chunk", "distance")


def vector_recall(s: SparkSession, d: str) -> DataFrame:
    """(query_id, found, probes, cells): of each 50th vector how many of its ten nearest a search finds with as many probes as other queries needed for 0.98 of theirs."""
    ix, asked = index(s, d), _of(s, d, "vec_id % 50 = 0")
    probes = ix.calibrated(_of(s, d, "vec_id % 50 = 25"), 10, 0.98)
    some = ix.nearest(asked, 10, probes=probes).select("query_id", "doc_id", "chunk", F.lit(1).alias("hit"))
    told = ix.nearest(asked, 10).join(some, ["query_id", "doc_id", "chunk"], "left").groupBy("query_id").agg(F.count("hit").alias("found"))
    return told.withColumns({"probes": F.lit(probes), "cells": F.lit(len(ix.cells[0]))})


QUERIES = {
    "vector_index_topk": lambda s, d: index(s, d).nearest(_of(s, d, "vec_id = 3"), 100).select("rank", (F.col("doc_id") * 4 + F.col("chunk")).alias("vec_id"), "distance"),
    "vector_index_many": lambda s, d: index(s, d).nearest(_of(s, d, "vec_id % 50 = 0"), 5).select("query_id", "rank", (F.col("doc_id") * 4 + F.col("chunk")).alias("vec_id"), "distance"),
    "vector_index_documents": lambda s, d: index(s, d).nearest(_of(s, d, "vec_id = 3"), 50, by_document=True).select("rank", "doc_id", "chunk", "distance"),
    "vector_index_filtered": vector_search,
    "vector_index_recall": vector_recall,
}

_FAR = "round(list_cosine_distance(CAST(e.embedding AS double[]), CAST(p.embedding AS double[])), 9)"
ORACLES = {
    "vector_index_topk": f"SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, distance FROM (SELECT e.vec_id, {_FAR} AS distance FROM embeddings e, embeddings p WHERE p.vec_id = 3 ORDER BY 2, 1 LIMIT 100) x",
    "vector_index_many": f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM (SELECT p.vec_id AS query_id, e.vec_id, {_FAR} AS distance FROM embeddings e JOIN embeddings p ON p.vec_id % 50 = 0) x QUALIFY rank <= 5",
    "vector_index_documents": f"SELECT row_number() OVER (ORDER BY distance, doc_id) AS rank, * FROM (SELECT e.vec_id // 4 AS doc_id, CAST(first(e.vec_id % 4 ORDER BY {_FAR}, e.vec_id) AS int) AS chunk, min({_FAR}) AS distance FROM embeddings e, embeddings p WHERE p.vec_id = 3 GROUP BY 1 ORDER BY 3, 1 LIMIT 50) x",
    "vector_index_filtered": f"SELECT row_number() OVER (ORDER BY distance, doc_id, chunk) AS rank, * FROM (SELECT e.vec_id // 4 AS doc_id, CAST(e.vec_id % 4 AS int) AS chunk, {_FAR} AS distance FROM embeddings e, embeddings p WHERE p.vec_id = 3 AND e.vec_id // 4 IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')) ORDER BY 3, 1, 2 LIMIT 20) x",
}
