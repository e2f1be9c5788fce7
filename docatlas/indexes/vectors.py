"""A stored vector index over chunks: cells around learned centres, a byte a dimension for the rest, exact distances at the end.

A search reads the codes of the cells that it probes, not the vectors. A code tells a cosine within a known error, so that only
chunks which can still be among the nearest are read whole. Cells know how far their vectors lie from the centre: an exact
search probes those that can hold a nearer one, and leaves the others unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors from which centres are learned (by hash), cells at most, rounds of learning, folders, queries to calibrate by.
SAMPLE, CELLS, ROUNDS, FOLDERS, BLOCK = 20_000, 4096, 12, 64, 256
#: Queries of a pass, and cosines that a task holds at once.
ASKED, HELD = 4096, 2_000_000
#: What floating point may lose in a cosine.
SLACK = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of unit vectors by k-means on the sphere; cells without vectors begin anew at the farthest one."""
    r = np.random.default_rng(4)
    c = x[r.permutation(len(x))[:cells]].copy()
    for _ in range(ROUNDS):
        near = x @ c.T
        own, best = near.argmax(1), near.max(1)
        for k in range(len(c)):
            mine = x[own == k]
            if len(mine):
                c[k] = mine.sum(0)
            else:
                far = int(best.argmin())
                c[k], best[far] = x[far], 2.0
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def build(vectors: DataFrame, path: str) -> None:
    """vectors (doc_id, chunk, embedding) to an index at path. Vectors that are null, zero, not finite or of another length than most have no place in it; repeated rows have one each."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("doc_id").cast("long"), F.col("chunk").cast("int"), F.col("embedding").cast("array<float>").alias("embedding")).withColumn("size", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    v = v.where("size > 0 and size < double('Infinity') and forall(embedding, x -> x is not null)")
    lengths = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (lengths.d, lengths["count"]) if lengths else (0, 0)
    v = v.where(F.size("embedding") == dim)
    some = v.orderBy(F.xxhash64("doc_id", "chunk"), "doc_id", "chunk").limit(SAMPLE).select("embedding").toPandas()
    x = np.array(some.embedding.tolist(), np.float32).reshape(-1, dim) if n else np.zeros((0, dim), np.float32)
    c = centres(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30), max(1, min(CELLS, round(n**0.5), len(x)))) if n else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ c.T
            cell = near.argmax(1)
            rest = x - c[cell]
            scale = np.maximum(abs(rest).max(1), 1e-30) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            lost = np.linalg.norm(rest - code * scale[:, None], axis=1)
            cols = [pa.array(cell.astype(np.int32)), b.column("doc_id"), b.column("chunk"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale), pa.array(lost), pa.array(near.max(1)), b.column("embedding")]
            yield pa.RecordBatch.from_arrays(cols, ["cell", "doc_id", "chunk", "code", "scale", "lost", "near", "embedding"])

    rows = v.select("doc_id", "chunk", "embedding").mapInArrow(run, "cell int, doc_id long, chunk int, code binary, scale double, lost double, near double, embedding array<float>")
    rows = rows.withColumn("folder", F.pmod("cell", F.lit(FOLDERS)).cast("int"))
    slices = max(1, n // (FOLDERS * 500_000))
    dealt = rows.repartition(FOLDERS * slices, "folder", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).sortWithinPartitions("folder", "cell")
    dealt.write.partitionBy("folder").option("parquet.block.size", 16 << 20).parquet(f"{path}/rows")
    held = spark.read.schema(ROWS).parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("rows"), F.min("near").alias("near"))
    told = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "cell int, centre array<float>")
    told.join(held, "cell").coalesce(1).write.parquet(f"{path}/cells")


ROWS = "cell int, doc_id long, chunk int, code binary, scale double, lost double, near double, embedding array<float>, folder int"


@dataclass
class Vectors:
    spark: SparkSession
    path: str

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres, rows and least cosines to the centre of the cells, CELLS at most."""
        got = self.spark.read.schema("cell int, centre array<float>, rows long, near double").parquet(f"{self.path}/cells").orderBy("cell").collect()
        return np.array([r.cell for r in got], int), np.array([r.centre for r in got], np.float32).astype(np.float64).reshape(len(got), len(got[0].centre) if got else 0), np.array([r.rows for r in got], float), np.array([r.near for r in got])

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows")

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """Which cells (columns) each unit query (rows) reads: the `probes` nearest."""
        near = q @ self.cells[1].T
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argsort(-near, 1)[:, :probes], True, 1)
        return out

    def reachable(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which cells can hold a vector whose cosine to a query is `least` or more."""
        angle = np.arccos(np.clip(q @ self.cells[1].T, -1, 1))
        wide = np.arccos(np.clip(self.cells[3], -1, 1))
        return np.cos(np.maximum(0, angle - wide[None, :])) >= least[:, None] - SLACK

    def _scanned(self, q: np.ndarray, reads: np.ndarray, least: np.ndarray, k: int, by_document: bool, only: DataFrame | None) -> DataFrame:
        """(query, cell, doc_id, chunk, low, high): what the codes of the cells tell; of a batch only what k others there do not surpass."""
        numbers, centre = self.cells[0], self.cells[1]
        place = {int(n): i for i, n in enumerate(numbers)}
        used = numbers[reads.any(0)].tolist()
        rows = self.rows.where(F.col("folder").isin(sorted({int(c) % FOLDERS for c in used})) & F.col("cell").isin([int(c) for c in used])) if used else self.rows.where("false")
        if only is not None:
            rows = rows.join(only, "doc_id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column("cell").to_numpy()
                docs, chunk = b.column("doc_id").to_numpy(), b.column("chunk").to_numpy()
                scale, lost = b.column("scale").to_numpy(), b.column("lost").to_numpy() + SLACK
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(len(cell), -1)
                for n in np.unique(cell):
                    at, j = np.flatnonzero(cell == n), place[int(n)]
                    at = at[np.argsort(docs[at], kind="stable")]
                    x, first = centre[j] + codes[at] * scale[at, None], np.flatnonzero(np.r_[True, docs[at][1:] != docs[at][:-1]])
                    asking = np.flatnonzero(reads[:, j])
                    for some in np.array_split(asking, -(-len(asking) * len(at) // HELD)) if len(asking) else ():
                        about = q[some] @ x.T
                        low, floor = about - lost[at], least[some]
                        sure = np.maximum.reduceat(low, first, axis=1) if by_document else low
                        if sure.shape[1] >= k:
                            floor = np.maximum(floor, np.partition(sure, sure.shape[1] - k, axis=1)[:, -k])
                        i, keep = np.nonzero(about + lost[at] >= floor[:, None])
                        cols = [some[i].astype(np.int32), np.full(len(i), n, np.int32), docs[at][keep], chunk[at][keep], low[i, keep], about[i, keep] + lost[at][keep]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "cell", "doc_id", "chunk", "low", "high"])

        return rows.select("cell", "doc_id", "chunk", "code", "scale", "lost").mapInArrow(run, "query int, cell int, doc_id long, chunk int, low double, high double")

    def _floors(self, found: DataFrame, k: int, by_document: bool) -> DataFrame:
        """(query, floor): the k-th best cosine that is sure, -2 where there are fewer."""
        one = found.groupBy("query", "doc_id").agg(F.max("low").alias("low")) if by_document else found.select("query", "low")
        top = one.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).where(F.col("r") <= k)
        return top.groupBy("query").agg(F.max(F.when(F.col("r") == k, F.col("low")).otherwise(-2.0)).alias("floor"))

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, by_document: bool = False, only: DataFrame | None = None) -> DataFrame:
        """queries (query_id, embedding) to (query_id, rank, doc_id, chunk, distance): the k nearest chunks by cosine distance, or the nearest chunk of the k nearest documents.

        With `probes` that many cells are read; without, as many as the exact answer needs. only: a table (doc_id) of the
        documents that count. Queries that are null, zero or of another length find nothing; they are taken in
        blocks of ASKED. Equal distances rank by doc_id and chunk.
        """
        out = None
        asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q")).orderBy("query_id")
        numbers, blocks = self.cells[0], -(-asked.count() // ASKED)
        for block in range(blocks):
            some = [r for r in asked.offset(block * ASKED).limit(ASKED).collect() if len(numbers) and len(r.q) == self.cells[1].shape[1] and 0 < sum((x or 0) * (x or 0) for x in r.q) < float("inf")]
            if not some:
                continue
            q = np.array([r.q for r in some], np.float64)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            none = np.full(len(q), -2.0)
            reads = self.probed(q, probes or max(1, len(numbers) // 16))
            found = self._scanned(q, reads, none, k, by_document, only)
            if probes is None:
                least = none.copy()
                for r in self._floors(found, k, by_document).collect():
                    least[r["query"]] = r.floor
                found = self._scanned(q, self.reachable(q, least), least, k, by_document, only)
            left = found.join(F.broadcast(self._floors(found, k, by_document)), "query").where("high >= floor").select("query", "cell", "doc_id", "chunk").distinct()
            told = self.spark.createDataFrame([(i, r.query_id, list(r.q)) for i, r in enumerate(some)], f"query int, query_id {asked.schema['query_id'].dataType.simpleString()}, q array<double>")
            exact = self.rows.select("cell", "doc_id", "chunk", "embedding").join(left, ["cell", "doc_id", "chunk"]).join(F.broadcast(told), "query")
            far = F.round(1 - dot(F.col("embedding"), F.col("q")) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("q"), F.col("q")))), 9)
            exact = exact.select("query_id", "doc_id", "chunk", far.alias("distance"))
            if by_document:
                exact = exact.groupBy("query_id", "doc_id").agg(F.min(F.struct("distance", "chunk")).alias("b")).select("query_id", "doc_id", "b.chunk", "b.distance")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id", "chunk"))
            top = exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "chunk", "distance")
            out = top if out is None else out.unionAll(top)
        if out is None:
            return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("chunk"), F.lit(0.0).alias("distance")).where("false")
        return out

    def calibrated(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """The fewest probes with which these queries (BLOCK of them at most) find a share `recall` of their k nearest, told by an exact search."""
        some = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q")).orderBy("query_id").limit(BLOCK)
        near = self.nearest(some.select("query_id", F.col("q").alias("embedding")), k).join(self.rows.select("cell", "doc_id", "chunk"), ["doc_id", "chunk"])
        hits = near.join(some, "query_id").select("query_id", "q", "cell").collect()
        if not hits:
            return 1
        place = {int(n): i for i, n in enumerate(self.cells[0])}
        q = np.array([r.q for r in hits], np.float64)
        order = np.argsort(np.argsort(-(q / np.linalg.norm(q, axis=1, keepdims=True)) @ self.cells[1].T, 1), 1)
        needed = np.sort(order[np.arange(len(hits)), [place[r.cell] for r in hits]])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1

    def share(self, queries: np.ndarray, probes: int) -> float:
        """Which share of all rows the unit queries read on average, with so many probes."""
        return float((self.probed(queries, probes) @ self.cells[2]).mean() / self.cells[2].sum())
