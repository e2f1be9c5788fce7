"""Cost-balanced packing of documents into sequences.

A piece costs a linear and a quadratic (attention) term. Descending documents go to the sequence of lowest cost
that still has room for them; where none has, the document is cut over those with any room left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, END_ID = 4096, 2
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Tokens that are packed together; what is left of them goes to sequences of a power of two.
GROUP = 6_000_000


def sequences(total: int, length: int = LENGTH) -> np.ndarray:
    """Capacities for `total` tokens: full sequences, then the powers of two that add up to the rest."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << k for k in range(length.bit_length(), -1, -1) if rest >> k & 1], np.int64)


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); sequences are filled to the token."""
    room = sequences(sum(lengths), length)
    cap, cost = room.copy(), np.zeros(len(room))
    out, full, items = [], 0, []
    for d, n in enumerate(lengths):
        whole = n // length
        for k in range(whole):
            out.append((d, k * length, length, full, 0))
            cost[full], room[full] = LINEAR * length + QUADRATIC * length**2, 0
            full += 1
        if n % length:
            items.append((n - whole * length, d, whole * length))
    items.sort(key=lambda x: (-x[0], x[1]))
    room, cap, cost = room[full:], cap[full:], cost[full:]
    closed = np.where(room > 0, 0.0, np.inf)
    for n, d, start in items:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            j = int(fits.argmin())
            if fits[j] == np.inf:
                j = int((cost + closed).argmin())
            k = int(min(n, room[j]))
            out.append((d, start, k, full + j, int(cap[j] - room[j])))
            room[j] -= k
            cost[j] += LINEAR * k + QUADRATIC * k * k
            closed[j] = 0.0 if room[j] else np.inf
            start, n = start + k, n - k
    return out


def packed(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each partition of docs is packed in groups of at most about GROUP tokens, so nothing is shuffled and memory does
    not grow with the table; a sequence's number tells its partition and its place there. The partition is read as a
    column, as one task takes several partitions where a coalesce follows. A null text is empty and has
    the end id alone. Repeated rows are documents of their own; rows without an id are dropped; other columns are
    ignored; an empty table gives no pieces.
    """
    common.tune(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        base, used, held, group = 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal used, held
            group.sort(key=lambda x: x[0])
            pieces = pack([len(x[1]) for x in group])
            rows = [(group[d][0], s, n, zlib.crc32(group[d][1][s : s + n].astype("<u4").tobytes()), len(group[d][1]), base + used + q, o) for d, s, n, q, o in pieces]
            used += 1 + max(p[3] for p in pieces)
            group.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for b in batches:
            if b.num_rows:
                base = b.column("part")[0].as_py() << 36
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(enc.encode(text), np.uint16(end_id))
                group.append((doc, ids))
                held += len(ids)
                if held >= GROUP:
                    yield flush()
        if group:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().cast("long").alias("part")).where("doc_id is not null").mapInArrow(run, ", ".join(f"{n} long" for n in names))
