"""Words of whole texts, gathered within a task by slices of texts: a row a word and slice, so that a frequent word is few rows wherever it is shuffled.

Words are what stands between blanks and ends of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that are taken apart at once.
SLICE = 16 << 20


def lists(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (word, held): how often each word stands in the documents (doc_id, n) of a slice."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: map(_listed, _sliced(batches)), f"word string, held array<struct<doc_id:{kind},n:int>>")


def places(docs: DataFrame, most: int) -> DataFrame:
    """docs (doc_id, text) to (word, n, first, last, places) of a slice: a word's count, its first and last place, and its first places in order, at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            row, ordinal, word = _words(b)
            yield _placed(word, b.column("doc_id").take(pa.array(row)), pa.array(ordinal, pa.int32()), _ranks(b.column("doc_id"))[row], ordinal, most)

    return docs.select("doc_id", "text").mapInArrow(run, _PLACES.format(docs.schema["doc_id"].dataType.simpleString(), "int"))


def placed(words: DataFrame, most: int) -> DataFrame:
    """words (doc_id, ordinal, word) to the same, by batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _placed(b.column("word"), b.column("doc_id"), b.column("ordinal"), _ranks(b.column("doc_id")), _ranks(b.column("ordinal")), most)

    kinds = (words.schema[c].dataType.simpleString() for c in ("doc_id", "ordinal"))
    return words.where("word is not null").select("doc_id", "ordinal", "word").mapInArrow(run, _PLACES.format(*kinds))


_PLACES = "word string, n long, first struct<doc_id:{0},ordinal:{1}>, last struct<doc_id:{0},ordinal:{1}>, places array<struct<doc_id:{0},ordinal:{1}>>"


def merged(rows: DataFrame, most: int) -> DataFrame:
    """Rows of places() to one for each word in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            kept = pa.concat_batches([kept, b]) if kept is not None else b
            if not kept.num_rows:
                continue
            kept = _merged(kept, most)
            yield kept.slice(0, kept.num_rows - 1)
            kept = kept.slice(kept.num_rows - 1)  # the last word may go on in the next batch
        if kept is not None:
            yield kept

    dealt = rows.withColumn("word", F.lower("word")).repartition("word").sortWithinPartitions("word")
    places = dealt.schema["places"].dataType.elementType
    return dealt.mapInArrow(run, _PLACES.format(*(f.dataType.simpleString() for f in places)))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches (doc_id, text) with SLICE bytes of texts at most, or one text."""
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield b.slice(at, end - at)
            at = end


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word its row, its place from 0 among the row's words, and itself."""
    said = pc.split_pattern(pc.replace_substring(b.column("text"), "\n", " "), " ")
    row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False))
    word = said.flatten()
    held = pc.greater(pc.binary_length(word), 0)
    row = row[held.to_numpy(zero_copy_only=False)]
    return row, np.arange(len(row)) - np.searchsorted(row, row), word.filter(held)


def _ranks(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values, equal ones for equal values; nulls come first."""
    return pc.rank(values, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return first, np.diff(np.r_[first, len(key)])


def _list(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)


def _listed(b: pa.RecordBatch) -> pa.RecordBatch:
    row, _, word = _words(b)
    coded = word.dictionary_encode()
    key = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * b.num_rows + row)
    first, n = _runs(key)
    code, row = key[first] // b.num_rows, key[first] % b.num_rows
    begun, docs = _runs(code)
    held = pa.StructArray.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(n.astype(np.int32))], ["doc_id", "n"])
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[begun])), _list(docs, held)], ["word", "held"])


def _placed(word: pa.Array, doc: pa.Array, ordinal: pa.Array, doc_rank: np.ndarray, rank: np.ndarray, most: int) -> pa.RecordBatch:
    coded = word.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((rank, doc_rank, code))
    code = code[order]
    first, n = _runs(code)
    near = np.arange(len(code)) - np.repeat(first, n) < most
    at = lambda i: pa.StructArray.from_arrays([doc.take(pa.array(i)), ordinal.take(pa.array(i))], ["doc_id", "ordinal"])
    cols = [coded.dictionary.take(pa.array(code[first])), pa.array(n.astype(np.int64)), at(order[first]), at(order[first + n - 1]), _list(np.minimum(n, most), at(order[near]))]
    return pa.RecordBatch.from_arrays(cols, ["word", "n", "first", "last", "places"])


def _merged(rows: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """Rows of places(), equal words side by side, to one a word."""
    ranks = lambda places: tuple(_ranks(pc.struct_field(places, c)) for c in ("ordinal", "doc_id"))
    first, n = _runs(rows.column("word").dictionary_encode().indices.to_numpy(zero_copy_only=False))
    mine = np.repeat(np.arange(len(first)), n)
    flat, last = rows.column("places").flatten(), rows.column("last")
    owner = np.repeat(mine, rows.column("places").value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((*ranks(flat), owner))
    begun, held = _runs(owner[order])
    near = np.arange(len(order)) - np.repeat(begun, held) < most
    cols = [rows.column("word").take(pa.array(first)), pa.array(np.add.reduceat(rows.column("n").to_numpy(), first)), flat.take(pa.array(order[begun])), last.take(pa.array(np.lexsort((*ranks(last), mine))[first + n - 1])), _list(np.minimum(held, most), flat.take(pa.array(order[near])))]
    return pa.RecordBatch.from_arrays(cols, ["word", "n", "first", "last", "places"])
