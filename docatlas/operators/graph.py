"""Walks over edge tables, one join a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distances(pairs: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """pairs (source, target) with the fewest of edges (src, dst) between them: 0 for equal nodes, -1 beyond `depth`.

    Each source is walked once for all its targets, and each node is left from once. Duplicate edges and pairs change
    nothing but the number of rows that come out, which is that of pairs; a null node is reached by none.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    front = seen = pairs.select("source", F.col("source").alias("node"), F.lit(0).alias("distance")).where("source is not null").distinct()
    for d in range(1, depth + 1):
        step = front.select("source", "node").join(links, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    met = seen.select("source", F.col("node").alias("target"), "distance")
    return pairs.join(met, ["source", "target"], "left").withColumn("distance", F.coalesce("distance", F.lit(-1)))
