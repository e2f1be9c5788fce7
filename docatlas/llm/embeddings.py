"""Embedding near-duplicates by collision counting on one-dimensional projections.

A window on one projection of the whole table holds a fixed share of all vectors, so counting over all of it would be
quadratic. Vectors are therefore dealt into cells by the signs of a few projections first, several tables over. In a
block of a cell each of many projections is sorted; the window centred at each vector's value (the query) is a range of
ranks, and the vectors whose ranks lie in it collide with the query. Pairs with as many collisions as the wanted recall
allows are verified by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE = 0.9
#: Rows that a cell aims at, rows of a block, projections that are counted, and what recall may lack in each step.
CELL, BLOCK, PROJECTIONS, LOSS = 512, 1024, 32, 1e-5
#: Half a window, in deviations of the difference of a pair at the limit.
HALF_WINDOW = 2.0


def tables_for(n: int) -> tuple[int, int]:
    """Sign projections a table and tables, for n vectors: a pair at the limit misses all tables with chance LOSS."""
    bits = min(24, max(3, round(math.log2(max(n, 1) / CELL)))) if n > CELL else 1
    p = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(LOSS) / math.log(1 - p))


def least_collisions() -> int:
    """The largest count that a pair at the limit reaches with chance 1 - LOSS at least (binomial)."""
    q = math.erf(HALF_WINDOW / math.sqrt(2))
    lost = 0.0
    for c in range(PROJECTIONS + 1):
        lost += math.comb(PROJECTIONS, c) * q**c * (1 - q) ** (PROJECTIONS - c)
        if lost > LOSS:
            return c
    return 0


def directions(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _unit(v: list | None) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    top = np.abs(a).max()
    if not np.isfinite(a).all() or top == 0:
        return None
    a = a / top
    return a / math.sqrt(float(a @ a))


def prepared(vectors: DataFrame, whole: bool = False) -> DataFrame:
    """(vec_id, v) to (vec_id, key), with whole to v besides: key names equal directions, null where a vector links with nothing."""
    kept = ["vec_id", *(["v"] if whole else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            keys = [None if (u := _unit(v)) is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(keys, pa.binary())], [*kept, "key"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("vec_id", "v").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "key binary"]))


def dealt(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """(..., v) to those with cells: the number of each table's cell, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeping("embeddings")
        for b in batches:
            out: list = []
            by: dict[int, list[int]] = {}
            units = [_unit(v) for v in b.column("v").to_pylist()]
            out = [None] * len(units)
            for i, u in enumerate(units):
                by.setdefault(len(u), []).append(i)
            for dim, rows in by.items():
                x = np.stack([units[i] for i in rows])
                signs = (x @ directions(1, dim, bits * tables) > 0).reshape(len(rows), tables, bits)
                cells = (signs << np.arange(bits)).sum(2).astype(np.uint32) if bits else np.zeros((len(rows), tables), np.uint32)
                for i, c in zip(rows, cells, strict=True):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary()), pa.array([len(u) for u in units], pa.int32())], [*b.schema.names, "cells", "dim"])

    return reps.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in reps.schema.fields)}, cells binary, dim int")


def windows(p: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the values of one projection: each one's rank, and the first rank and the width of the window of `half` to both sides of it."""
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p), np.uint16)
    ranks[order] = np.arange(len(p), dtype=np.uint16)
    first = np.searchsorted(p[order], p - half, "left")
    return ranks, first.astype(np.uint16), (np.searchsorted(p[order], p + half, "right") - first).astype(np.uint16)


def collisions(swept: list, queries: np.ndarray, n: int) -> np.ndarray:
    """How many projections have each of n vectors in the window of each query."""
    count = np.zeros((len(queries), n), np.uint8)
    for ranks, first, width in swept:
        count += (ranks[None, :] - first[queries, None]) < width[queries, None]  # below the window: wraps round to a large number
    return count


def block_links(x: np.ndarray, cells: np.ndarray, table: int, chunk: np.ndarray, ids: np.ndarray, mult: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in one block: what each row's degree gains and the smallest id it is linked to through this block.

    Rows of two chunks are held across only, of one chunk among themselves. A pair is counted in the first table
    in which its cells agree, so that no pair counts twice; in any other it still joins.
    """
    n = len(x)
    half = HALF_WINDOW * math.sqrt(2 - 2 * COSINE)
    swept = [windows(v, half) for v in (x @ directions(2, x.shape[1], PROJECTIONS)).T]
    need, two = least_collisions(), len(np.unique(chunk)) > 1
    degree, root = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        ok = (collisions(swept, rows, n) >= need) & (rows[:, None] < np.arange(n)[None, :])
        if two:
            ok &= chunk[rows, None] != chunk[None, :]
        i, j = np.nonzero(ok)
        for s in range(0, len(i), 65536):
            a, b = rows[i[s : s + 65536]], j[s : s + 65536]
            good = np.einsum("ij,ij->i", x[a], x[b]) >= COSINE
            a, b = a[good], b[good]
            if len(a):
                fresh = (cells[a] == cells[b]).argmax(1) == table
                degree += np.bincount(a[fresh], mult[b[fresh]], n).astype(np.int64) + np.bincount(b[fresh], mult[a[fresh]], n).astype(np.int64)
                # a forest is enough: each row with its smallest partner so far, then the rest of other trees
                r = np.array([find(k) for k in range(n)])
                for k, m in set(zip(r[a].tolist(), r[b].tolist(), strict=True)):
                    u, w = find(k), find(m)
                    if u != w:
                        root[max(u, w)] = min(u, w)
    r = np.array([find(k) for k in range(n)])
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, r, ids)
    return degree, low[r]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) to (vec_id, n_links, component_id, kept) by cosine >= COSINE.

    Equal directions are one class; classes are compared, and copies are links by count. A cell larger than BLOCK
    is split by a hash and held chunk against chunk, so no task gets an unbounded cell. Null and zero vectors and
    vectors with null or non-finite components have no links; vectors of other dimensions never link. Rows of one
    vec_id with equal vectors are one vector; with other vectors they are vectors of their own, of which each row
    tells the links, while the id has the components of all of them. Rows without an id are dropped; other columns
    are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.tune(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null")
    keyed = common.written(prepared(base), "emb-keys")
    with common.Scratch(spark) as scratch:
        once = keyed.where("key is not null").distinct()
        classes = common.written(once.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "emb-classes")
        bits, tables = tables_for(classes.count())
        units = scratch.written(prepared(base, True).where("key is not null").join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", "key"]).dropDuplicates(["key"]), "emb-units")
        cells = scratch.written(dealt(units, bits, tables), "emb-cells")
        spread = cells.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t", "_")).withColumn("cell", F.substring("cells", F.col("t") * 4 + 1, F.lit(4))).drop("_")
        sizes = spread.groupBy("t", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")).where("chunks > 1")
        spread = spread.join(sizes, ["t", "dim", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
        blocks = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("t", "dim", "cell", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "chunk", "key", "vec_id", "mult", "v", "cells")

        def run(at: tuple, block: pa.Table) -> pa.Table:
            block = block.sort_by([("vec_id", "ascending"), ("key", "ascending")])
            x = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, at[1].as_py())
            x = x / np.abs(x).max(1)[:, None]
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            ids, mult = block.column("vec_id").to_numpy(), block.column("mult").to_numpy()
            cells_ = np.frombuffer(b"".join(block.column("cells").to_pylist()), np.uint32).reshape(len(ids), -1)
            degree, low = block_links(x, cells_, at[0].as_py(), block.column("chunk").to_numpy(), ids, mult)
            some = (degree > 0) | (low != ids)
            return pa.table({"key": block.column("key").filter(pa.array(some)), "a": ids[some], "b": low[some], "n": degree[some]})

        found = scratch.written(blocks.groupBy("t", "dim", "cell", "lo", "hi").applyInArrow(run, "key binary, a long, b long, n long"), "emb-links")
        several = once.join(classes.select("key", "rep"), "key").groupBy("vec_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
        labels = common.components(found.select("a", "b").union(several.select(F.explode("all"), "b")), "emb-cc").withColumnRenamed("node", "rep")
        degrees = found.groupBy("key").agg(F.sum("n").alias("n"))
        of = common.written(classes.join(degrees, "key", "left").join(labels, "rep", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id")), "emb-of")
    out = keyed.join(of, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
