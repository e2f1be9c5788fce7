"""Merges of a batch into a table by key, written as plans over columnar files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row a key, that of the greatest `by`; partial aggregation keeps hot keys small."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(*keys, "r.*").select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """new replaces old by key; with `only`, no more than these columns of a row that both have."""
    if only is None:
        return new.unionByName(old.join(new.select(keys), keys, "left_anti"))
    renamed = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in only], F.lit(True).alias("_hit"))
    kept = old.join(renamed, keys, "left").select(*[F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in only else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(keys), keys, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def fused(tiers: DataFrame, k: int = 60) -> DataFrame:
    """tiers (tier, doc_id, rank) to (doc_id, score) by reciprocal ranks; a document's best rank in each tier counts."""
    best = tiers.groupBy("tier", "doc_id").agg(F.min("rank").alias("rank"))
    return best.groupBy("doc_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank") + 1)).alias("score"))
