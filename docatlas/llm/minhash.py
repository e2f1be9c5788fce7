"""MinHash near-duplicates with odd sketches.

Each distinct shingle set gets MinHash samples; bands of samples propose pairs, the samples folded into a parity
bitmap (odd sketch) let the population count of an XOR estimate a pair's similarity, and what stays is confirmed
on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, NUMERATOR = 5, 75
BANDS, ROWS, BITS = 32, 4, 256
#: Pairs whose sketches say less are not confirmed: five deviations below the limit.
LEAST_ESTIMATE = 0.5
#: Members of a bucket that are compared at once, parts that rows of one set are joined in.
CHUNK, SALTS = 1024, 32
_M = (1 << 64) - 1


class WordHash(dict):
    """64-bit hashes of words, kept; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash = WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_power = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; bytes.lower and bytes.split are ASCII, as the words are defined."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = np.full(n, np.uint64(min(len(h), WORDS)), np.uint64)
    for i in range(min(WORDS, len(h))):
        s = s + _mix(h[i : i + n] + np.uint64(i)) * _power[i]
    return np.unique(_mix(s))


_rng = np.random.default_rng(20240229)
_mul = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def samples(s: np.ndarray) -> np.ndarray:
    """One minimum for each of the hash functions, in blocks of bounded size."""
    out = np.full(BANDS * ROWS, _M, np.uint64)
    for at in range(0, len(s), 2048):
        x = s[at : at + 2048, None] * _mul + _add
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(0))
    return out


def odd_sketch(mins: np.ndarray) -> list[int]:
    """BITS parity bits as signed longs: each sample flips the bit that it hashes to."""
    at = (_mix(mins + np.arange(len(mins), dtype=np.uint64) * _power[0]) >> np.uint64(40)).astype(np.int64) % BITS
    odd = np.bincount(at, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def band_keys(mins: np.ndarray) -> list[int]:
    m = mins.reshape(BANDS, ROWS)
    x = np.arange(BANDS, dtype=np.uint64) * _power[1]
    for i in range(ROWS):
        x = _mix(x ^ m[:, i]) * _power[2]
    return _mix(x).view(np.int64).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        common.keeping("minhash", _hash.clear)
        for b in batches:
            n, key, sketch, bands = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                m = samples(s) if len(s) else None
                sketch.append(odd_sketch(m) if len(s) else None)
                bands.append(band_keys(m) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch array<long>, bands array<long>")


def estimate(left: str, right: str):
    """Similarity from the bits in which two odd sketches differ."""
    apart = sum(F.bit_count(F.element_at(left, i).bitwiseXOR(F.element_at(right, i))) for i in range(1, BITS // 64 + 1))
    inside = F.greatest(F.lit(1e-9), 1 - 2.0 * apart / BITS)
    return 1 + F.log(inside) * BITS / (4.0 * BANDS * ROWS)


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    a = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where(estimate("sa", "sb") >= LEAST_ESTIMATE).select("a", "b").distinct()


def groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Runs of equal values of a sorted stream's column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(by).to_numpy(zero_copy_only=False)
        if held and held[-1].column(by)[0].as_py() != g[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for end in [*(np.nonzero(g[1:] != g[:-1])[0] + 1).tolist(), len(g)]:
            held.append(b.slice(start, end - start))
            start = end
            if end < len(g):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def alike(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one bucket that are of two components, meet first in this band and have like sketches; likeliest first."""
    col = {n: t.column(n).to_numpy() for n in ("band", "chunk", "b", "label")}
    if (col["label"] == col["label"][0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sk = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(t), -1).view(np.uint64)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    most = int(BITS / 2 * (1 - np.exp(-4.0 * BANDS * ROWS * (1 - LEAST_ESTIMATE) / BITS)))
    two, band, got = len(np.unique(col["chunk"])) > 1, int(col["band"][0]), []
    for at in range(0, len(t), 256):
        part = slice(at, at + 256)
        apart = sum(np.bitwise_count(sk[part, None, i] ^ sk[None, :, i]).astype(np.int16) for i in range(sk.shape[1]))
        ok = (apart <= most) & (col["label"][part, None] != col["label"][None, :]) & (np.arange(len(t))[part, None] < np.arange(len(t))[None, :]) & (col["b"][part, None] != col["b"][None, :])
        if two:
            ok &= col["chunk"][part, None] != col["chunk"][None, :]
        i, j = np.nonzero(ok)
        for s in range(0, len(i), 65536):
            x, y = i[s : s + 65536] + at, j[s : s + 65536]
            fresh = (bands[x] == bands[y]).argmax(1) == band
            got.append(np.stack([apart[x - at, y], x, y], 1)[fresh])
    p = np.concatenate(got) if got else np.zeros((0, 3), np.int64)
    p = p[np.argsort(p[:, 0], kind="stable")]
    return p[:, 1], p[:, 2]


def across(members: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components, as a forest of each bucket.

    A task compares a bucket's sketches in memory and passes on members that have a like one; these come together
    once more with their texts, and a task confirms like pairs on whole sets. Neither gives out pairs that fail or
    that join nothing, so no more rows come out than go in. A bucket of more than CHUNK members is held chunk
    against chunk.
    """
    placed = members.select("key", "band", "b").join(labels.withColumnRenamed("node", "b"), "b", "left").select("key", "band", "b", F.coalesce("label", "b").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("lo <> hi").select("key", "chunks")
    rows = placed.join(mixed, "key").join(reps.select(F.col("doc_id").alias("b"), "sketch", "bands"), "b").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("g"), "band", "chunk", "b", "label", "sketch", "bands")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "g"):
            some = np.unique(np.concatenate(alike(t)))
            if len(some):
                yield from t.take(pa.array(some)).combine_chunks().to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "g"):
            label, ids, root = t.column("label").to_pylist(), t.column("b").to_pylist(), {}
            sets = [shingles(x) for x in t.column("text").to_pylist()]
            out = []

            def find(x: int) -> int:
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            for i, j in zip(*(x.tolist() for x in alike(t)), strict=True):
                u, w = find(label[i]), find(label[j])
                if u != w:
                    x, y = sets[i], sets[j]
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    if 100 * both >= NUMERATOR * (len(x) + len(y) - both):
                        root[max(u, w)] = min(u, w)
                        out.append((ids[i], ids[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    few = scratch.written(rows.repartition(n, "g").sortWithinPartitions("g", "b").mapInArrow(needed, rows.schema), "minhash-needed")
    whole = few.join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    return whole.repartition(n, "g").sortWithinPartitions("g", "b", "text").mapInArrow(linked, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * common >= 75 * all."""
    named = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if last[0] != ta:
                    last = (ta, shingles(ta))
                x, y = last[1], shingles(tb)
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(bool(len(x) and len(y)) and 100 * both >= NUMERATOR * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(other, "b").join(named, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept).

    Equal sets are one class; only its first document is compared. In round one each member of a band bucket is
    held against the bucket's first only, a row a member; in round two, members of a bucket that are still in
    different components are compared in memory. Both rounds drop pairs by sketch and confirm the rest on whole
    sets.
    Texts without words (null, empty) link with nothing. Repeated rows of one doc_id give a row each, and a link
    of any of its texts is a link of the id; rows without doc_id are dropped; other columns are ignored; an empty
    table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    sig = common.written(signatures(d), "minhash")
    with common.Scratch(docs.sparkSession) as scratch:
        classes = scratch.written(sig.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "minhash-classes")
        reps = scratch.written(sig.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("n_shingles > 0").select("doc_id", "sketch", "bands"), "minhash-reps")
        rows = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
        first = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
        members = scratch.written(rows.join(first, "key").select("key", "band", "a", F.col("doc_id").alias("b")), "minhash-members")
        sketches = reps.select("doc_id", "sketch")
        tried = scratch.written(likely(members.where("a <> b").select("a", "b").distinct(), sketches), "minhash-pairs")
        involved = members.select(F.col("b").alias("doc_id")).distinct()
        texts = scratch.written(d.join(involved.hint("shuffle_hash"), "doc_id", "left_semi"), "minhash-texts")
        links = scratch.written(confirmed(tried, texts), "minhash-links")
        labels = common.components(links, "minhash-cc")
        late = scratch.written(across(members, labels, reps, texts, scratch).distinct(), "minhash-late")
        if late.limit(1).count():
            labels = common.components(links.union(late), "minhash-cc")
        # rows of one set may be a third of all: a class of several rows is joined by parts of it, any other row is its own class
        several = classes.where("n > 1").select("set_key", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = sig.withColumn("salt", F.when(F.col("n_shingles") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int") + SALTS))
        rep = common.written(salted.join(several, ["set_key", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "minhash-classed")
    out = rep.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
