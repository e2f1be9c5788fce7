"""Sorted-string-table shards of token ids.

A shard: magic; blocks of entries with prefix-compressed keys, deflated, each with its checksum; a sparse index of
the blocks' first keys; a Bloom filter of all keys; a footer of fixed size. Keys are doc_ids as 8 bytes in sorting
order and 4 bytes that tell repeated ids apart; values are ids of 2 or 4 bytes, little-endian. A lookup reads the
footer, asks the filter, and searches the index and then one block by halving.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, FOOTER = b"SSTIDS01", struct.Struct("<QQQQQQBB8s")
#: Bytes of a block before deflating, bytes of a shard's values and keys before a new one begins, bits a key and probes of the filter.
BLOCK, SHARD, KEYS, BITS, PROBES = 1 << 16, 1 << 26, 1 << 19, 10, 7
#: Rows that a reader gives out at once.
ROWS = 1 << 16
END_ID = 1


def key_of(doc_id: int, nth: int = 0) -> bytes:
    return struct.pack(">QI", doc_id + (1 << 63), nth)


def doc_of(key: bytes) -> int:
    return struct.unpack(">QI", key)[0] - (1 << 63)


def probes(key: bytes, size: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, 1) | 1
    return [(a + i * b) % size for i in range(PROBES)]


class Writer:
    """Takes keys in ascending order."""

    def __init__(self, sink, width: int = 2):
        self.sink, self.width, self.at = sink, width, len(MAGIC)
        sink.write(MAGIC)
        self.block, self.filled, self.last, self.first = [], 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = self.size = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.filled == 0:
            self.first, self.last = key, b""
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += [struct.pack("<BBI", shared, len(key) - shared, len(value)), key[shared:], value]
        self.filled += 6 + len(key) - shared + len(value)
        self.size += len(value)
        self.ids += len(ids)
        self.last = key
        self.keys.append(key)
        if self.filled >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.filled:
            raw = b"".join(self.block)
            packed = zlib.compress(raw, 1)
            self.sink.write(packed + struct.pack("<I", zlib.crc32(raw)))
            self.index.append((self.first, self.at, len(packed) + 4))
            self.at += len(packed) + 4
            self.block, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[probes(k, bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self.sink.write(index + packed)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.ids, self.width, 1, MAGIC))
        self.sink.close()


class Reader:
    """source: a seekable file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.n_keys, self.n_ids, self.width, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        source.seek(index_at)
        raw, self.first, self.places, i = source.read(index_size), [], [], 0
        while i < len(raw):
            n = raw[i]
            self.first.append(raw[i + 1 : i + 1 + n])
            self.places.append(struct.unpack_from("<QQ", raw, i + 1 + n))
            i += 17 + n
        self.bloom_at = bloom_at

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n = self.places[k]
        self.source.seek(at)
        packed = self.source.read(n)
        raw = zlib.decompress(packed[:-4])
        if zlib.crc32(raw) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        i, last = 0, b""
        while i < len(raw):
            shared, own, size = struct.unpack_from("<BBI", raw, i)
            last = last[:shared] + raw[i + 6 : i + 6 + own]
            i += 6 + own
            yield last, np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", size // self.width, i)
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def get(self, key: bytes) -> np.ndarray | None:
        for p in probes(key, self.bits):
            self.source.seek(self.bloom_at + p // 8)
            if not self.source.read(1)[0] & (128 >> p % 8):
                return None
        k = bisect_right(self.first, key) - 1
        if k < 0:
            return None
        entries = list(self.block(k))
        at = bisect_right(entries, key, key=lambda e: e[0]) - 1
        return entries[at][1] if at >= 0 and entries[at][0] == key else None


def opened(uri: str, write: bool = False):
    """A file in the shared store: any file system that pyarrow knows by its scheme."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if not write:
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def write_shards(docs: DataFrame, to: str, vocabulary: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encodes (doc_id, text) into shards under the URI `to`, in ascending doc_id order over all shards.

    Returns the manifest (path, first_key, n_docs, n_ids), written: a row a shard. A task that is run again writes
    new files; the manifest names those of the attempt that counted.
    """
    spark = docs.sparkSession
    common.tune(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), tokens.encoder(vocabulary)
        out: dict[str, list] = {"path": [], "first_key": [], "n_docs": [], "n_ids": []}
        writer, path, first, last, nth = None, "", b"", None, 0

        def done() -> None:
            writer.close()
            for k, v in zip(out, (path, first, len(writer.keys), writer.ids), strict=True):
                out[k].append(v)

        width = 2 if enc.tok.get_vocab_size() <= 65536 else 4
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                nth = nth + 1 if doc == last else 0
                last, key = doc, key_of(doc, nth)
                if writer is None:
                    path, first = f"{to}/{part:06d}-{len(out['path']):04d}-{uuid.uuid4().hex}.sst", key
                    writer = Writer(opened(path, True), width)
                writer.add(key, np.append(enc.encode(text), np.uint16(end_id)))
                if writer.size >= SHARD or len(writer.keys) >= KEYS:
                    done()
                    writer = None
        if writer is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["first_key"], pa.binary()), pa.array(out["n_docs"], pa.int64()), pa.array(out["n_ids"], pa.int64())], list(out))

    return common.written(d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "path string, first_key binary, n_docs long, n_ids long"), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Reads the shards of a manifest back: (doc_id, start, n_tokens, ids_crc32)."""
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("start"))

    def told(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                rows: list[tuple[int, ...]] = []
                with opened(path) as f:
                    for key, ids in Reader(f):
                        rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= ROWS:
                            yield told(rows)
                            rows = []
                if rows:
                    yield told(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Documents to shards and back to what the shards hold of each.

    A null text is empty and has the end id alone. Repeated doc_ids are entries of their own, in order of their
    texts; rows without an id are dropped; other columns are ignored; an empty table gives no shards and no rows.
    """
    return read_shards(write_shards(docs, common.fresh_path(docs.sparkSession, "sst"), vocabulary, end_id))
