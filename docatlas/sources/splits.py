"""Records of large quoted files, read by many tasks a file.

Whether a line begins inside quotes depends on all lines before it, but only by one bit, and a line does one of three things to
that bit: keep it, turn it round, or set it. So a first pass tells what each split of a file does to it, prefixes over the
splits give the bit at the beginning of each, and a second pass reads all splits at once. What a split has of a record that
goes over its edge is put together afterwards, at most two pieces a split. A file may be of any size; gzip is read by one
task, line by line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits of which the states are broadcast; beyond, lines are joined with them by split.
SMALL = 200_000
_QUOTED = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)
_WHOLE = re.compile(rb'(?:[^"\r]|"(?:[^"\\]|\\.)*(?:"|\\?\Z))+', re.S)
#: A line that goes on with the base64 of the line before it.
_BASE64 = re.compile(rb"[A-Za-z0-9+/=]{30,}(?![^,]*,)")


def _left(line: bytes, inside: bool) -> bool:
    """Whether a quote is open at the end of a line."""
    if b"\\" not in line:
        return (line.count(b'"') % 2 == 1) != inside
    return b'"' in _QUOTED.sub(b"", b'"' + line if inside else line)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line"))


def states(lines: DataFrame, start: str | None = None) -> DataFrame:
    """(path, split, line) to (path, split, inside, offset): whether a split begins inside quotes, and where its first line lies in the file.

    start: a pattern of a line that always begins a record, whatever was open before it.
    """
    sound = re.compile(start.encode()) if start else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, size, out = None, (False, True), 0, []
        for b in batches:
            for path, split, line in zip(*(b.column(c).to_pylist() for c in ("path", "split", "line")), strict=True):
                if (path, split) != key:
                    if key:
                        out.append((*key, *ends, size))
                    key, ends, size = (path, split), (False, True), 0
                size += len(line) + 1
                if sound and sound.match(line):
                    ends = (_left(line, False),) * 2
                elif b'"' in line:
                    ends = tuple(_left(line, e) for e in ends)
        if key:
            out.append((*key, *ends, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()))], ["path", "split", "out", "in_", "size"])

    each = lines.mapInArrow(run, "path string, split long, out boolean, in_ boolean, size long")
    w = Window.partitionBy("path").orderBy("split")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # What splits before this one did last that does not depend on what they found, and how often the bit was turned round since.
    turns = F.sum(F.when(F.col("out") & ~F.col("in_"), 1).otherwise(0))
    each = each.withColumn("turns", turns.over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.when(F.col("out") == F.col("in_"), F.struct(F.col("out").cast("int").alias("bit"), "turns")), ignorenulls=True).over(before)
    each = each.select("path", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), fixed.alias("fixed"), F.coalesce(F.last("turns").over(before), F.lit(0)).alias("so_far"))
    bit = F.coalesce(F.col("fixed.bit"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("fixed.turns"), F.lit(0))
    return each.select("path", "split", (bit % 2 == 1).alias("inside"), "offset")


def records(spark: SparkSession, path: str, start: str | None = None, joins: bool = False) -> DataFrame:
    """(path, offset, record): the records of files as bytes, with the place of their first byte; blank ones are left out.

    A record ends at a line's end outside quotes; quotes are doubled inside quotes or escaped by a backslash. With `start`,
    a line of that pattern begins a record even if a quote is open, so that damage ends there; with `joins`, a line of base64
    goes on with the record before it.
    """
    lines = _lines(spark, path)
    known = states(lines, start)
    sound = re.compile(start.encode()) if start else None
    few = known.count() <= SMALL
    rows = lines.join(F.broadcast(known), ["path", "split"]) if few else _in_order(lines, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, at, held = None, False, 0, None  # held: [place of the record, its lines], or None before the first
        out: list[tuple] = []
        size = 0

        def close(kind: int) -> None:
            """Hands on what is held: 0 goes on with a record of a split before, 1 may go on in the next, 2 is whole."""
            nonlocal held
            if held:
                text = b"\n".join(held[1])
                out.append((*key, kind, held[0], text))
            held = None

        first = True
        for b in batches:
            for p, s, line, opens, offset in zip(*(b.column(c).to_pylist() for c in ("path", "split", "line", "inside", "offset")), strict=True):
                if (p, s) != key:
                    if key:
                        close(0 if first else 1)
                    key, inside, at, first = (p, s), opens, offset, True
                goes_on = inside and not (sound and sound.match(line)) or (not inside and joins and _BASE64.match(line) is not None and not (sound and sound.match(line)))
                if goes_on and held:
                    held[1].append(line)
                elif goes_on:
                    held = [at, [line]]
                else:
                    close(0 if first and held else 2)
                    first = False
                    held = [at, [line]]
                if sound and sound.match(line):
                    inside = False
                inside = _left(line, inside)
                at += len(line) + 1
                size += len(line)
            if size > 8 << 20 and out:
                yield _pieces(out)
                out.clear()
                size = 0
        if key:
            close(0 if first else 1)
        yield _pieces(out)

    pieces = rows.select("path", "split", "line", "inside", "offset").mapInArrow(run, "path string, split long, kind int, offset long, record binary")
    w = Window.partitionBy("path").orderBy("split", "kind")
    edges = pieces.where("kind < 2").withColumn("no", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.groupBy("path", "no").agg(F.min("offset").alias("offset"), F.sort_array(F.collect_list(F.struct("offset", "record"))).alias("r"))
    whole = whole.select("path", "offset", F.aggregate(F.slice("r.record", 2, 1 << 30), F.get("r.record", F.lit(0)), lambda a, x: F.concat(a, F.lit(bytearray(b"\n")), x)).alias("record"))
    return whole.unionByName(pieces.where("kind = 2").select("path", "offset", "record")).mapInArrow(_parted, "path string, offset long, record binary")


def _in_order(lines: DataFrame, known: DataFrame) -> DataFrame:
    numbered = lines.withColumn("n", F.monotonically_increasing_id())
    return numbered.join(known.hint("shuffle_hash"), ["path", "split"]).repartition("path", "split").sortWithinPartitions("path", "split", "n").drop("n")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "split", "kind", "offset", "record"])


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records at a bare CR outside quotes are two; line ends and blank records go."""
    for b in batches:
        out = []
        for p, o, r in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "record")), strict=True):
            if b"\r" in r:
                out += [(p, o + m.start(), m[0]) for m in _WHOLE.finditer(r)]
            elif r:
                out.append((p, o, r))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["path", "offset", "record"])


_FIELD = re.compile(rb'(?:^|,)(?:"((?:[^"\\]|\\.|"")*)"(?=,|\Z)|([^,]*))', re.S)
#: What is left of JSON that was broken over lines: it begins with a closing bracket or a key, or ends with a bracket.
_JSON_REST = re.compile(rb'^\s*(?:[\]}]|"[^"]*"\s*:)|[\]}]\s*"?\s*$')
_SAID = {b'\\"': b'"', b'""': b'"', b"\\\\": b"\\", b"\\n": b"\n", b"\\r": b"\r", b"\\t": b"\t"}
_ESCAPE = re.compile(rb'\\["\\nrt]|""')


def fields(record: bytes) -> list[bytes | None]:
    r"""The fields of a record: quotes off, escapes read, a bare \N null. An unsound quote stays as it stands."""
    return [_ESCAPE.sub(lambda e: _SAID[e[0]], m[1]) if m[1] is not None else None if m[2] == b"\\N" else m[2] for m in _FIELD.finditer(record)]


def dump(spark: SparkSession, path: str, columns: list[str], start: str | None = None, joins: bool = False, numbers: int = 0, header: bool = False) -> tuple[DataFrame, DataFrame]:
    r"""(path, offset, <columns>) of the sound records of files, and (path, offset, record, reason) of the others: nothing is lost in silence.

    A sound record has as many fields as columns, and digits alone in the first `numbers`; of the others, those of up to three
    fields that look like it are told to be fragments of JSON. Fields come as text; bytes that are
    no UTF-8 become replacement characters there. With a header, the first record of a file is left out.
    """
    rows = records(spark, path, start, joins)
    rows = rows.where("offset > 0") if header else rows
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for r in b.column("record").to_pylist():
                f = fields(r)
                rest = len(f) <= 3 < width and _JSON_REST.search(r)
                bad = "a fragment of JSON" if rest else f"{len(f)} fields, not {width}" if len(f) != width else next((f"no number in field {i + 1}" for i in range(numbers) if not (f[i] or b"").strip().isdigit()), None)
                if bad is None and b'"' in r and _left(r, False):
                    bad = "a quote is open"
                got.append(([None if x is None else x.decode("utf-8", "replace") for x in f] if bad is None else None, bad))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("offset"), b.column("record"), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())], ["path", "offset", "record", "f", "reason"])

    told = rows.mapInArrow(run, "path string, offset long, record binary, f array<string>, reason string")
    return told.where("reason is null").select("path", "offset", *(F.col("f")[i].alias(c) for i, c in enumerate(columns))), told.where("reason is not null").select("path", "offset", "record", "reason")


#: Seven columns, four numbers first: how a sound row of the code lists begins.
CODE_COLUMNS = ("row_number", "dense_rank", "row_in_group", "rank_in_group", "code", "record_id", "group")
CODE_START = r"[0-9]+ *,[0-9]+ *,[0-9]+ *,[0-9]+ *,"


def codes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of code lists, which hold any bytes, and what is damaged: reading goes on at the next line that begins like a row."""
    return dump(spark, path, list(CODE_COLUMNS), CODE_START, numbers=4)
