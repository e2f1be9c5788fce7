"""Divergence of sources: how far the term shares of a language's sources lie apart, and which terms set each apart.

Tasks count terms per language and source and deal what they have counted to shards by a hash of language and term.
A shard is summed by DuckDB, which then holds every count of its terms; what it knows of pairs of sources and of the
terms of a source are partial sums and rankings, which Spark merges.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents in which a kept term stands at least, what is added to a count, terms told of a source.
LEAST, ADDED, TOLD = 30, 5, 50
#: Shards at least, documents of a shard, and counts that a task holds before it passes them on.
SHARDS, SHARD_DOCS, HELD = 16, 4_000, 400_000
#: Shards into which one is dealt at once, and tasks that read one shard to deal it out further.
FAN, SPREAD = 512, 16
#: Every byte as it counts: A-Z in lower case, what belongs to no term a blank.
_FOLD = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ENTRY = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """The terms of a whole UTF-8 text: letters of ASCII and any other characters beyond it."""
    return text.translate(_FOLD).split()


def _packed(rows: list[tuple]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY))
    return out.getvalue().to_pybytes()


def _held(shards: int, seen: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Counts (lang, source, counts by term, documents by term) to (shard, entries); what is held is passed on at HELD counts or where seen gives None."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for (lang, source), (n, held) in counts.items():
            seed = zlib.crc32(lang.encode())
            for t, c in n.items():
                parts.setdefault(zlib.crc32(t, seed) % shards, []).append((lang, t.decode("utf-8", "replace"), source, c, held[t]))
        counts.clear()
        keys = sorted(parts)
        for i in range(0, len(keys), 64):
            some = keys[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_packed(parts.pop(k)) for k in some], pa.binary())], ["shard", "entries"])

    size = 0
    for x in seen:
        if x:
            n, held = counts.setdefault(x[:2], (Counter(), Counter()))
            size -= len(n)
            n.update(x[2])
            held.update(x[3])
            size += len(n)
        if x is None or size >= HELD:
            yield from flush()
            size = 0
    yield from flush()


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, source, text) to (shard, entries): compressed columns (lang, term, source, n, docs) of what a task has counted."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeping("divergence")
        rows = ((lang, source, ws, set(ws)) for b in batches for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True) for ws in [terms(text)])
        return _held(shards, rows)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "shard int, entries binary")


def finer(parts: DataFrame, shards: int, tasks: int) -> DataFrame:
    """Entries of few shards to entries of more: a shard is read by many tasks, each of which adds up what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seen() -> Iterator[tuple | None]:
            last = None
            for b in batches:
                for shard, blob in zip(b.column("shard").to_pylist(), b.column("entries").to_pylist(), strict=True):
                    if last is not None and shard != last:
                        yield None
                    last = shard
                    for lang, term, source, n, held in zip(*(c.to_pylist() for c in pa.ipc.open_stream(blob).read_all().columns), strict=True):
                        key = term.encode()
                        yield (lang, source, {key: n}, {key: held})

        return _held(shards, seen())

    spread = parts.repartition(tasks, "shard", F.pmod(F.xxhash64("entries"), F.lit(SPREAD))).sortWithinPartitions("shard")
    return spread.mapInArrow(run, "shard int, entries binary")


_db = None


def _told(sql: str, schema: pa.Schema, **tables: pa.Table) -> pa.Table:
    """What DuckDB makes of these tables: one database in memory a worker, one thread, as Spark gives a task one."""
    global _db
    if _db is None:
        import duckdb

        _db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": False})

    def drop() -> None:
        global _db
        _db.close()
        _db = None

    common.keeping("divergence-shards", drop)
    for name, t in tables.items():
        _db.register(name, t)
    got = _db.sql(sql).arrow()
    got = (got if isinstance(got, pa.Table) else got.read_all()).cast(schema)
    for name in tables:
        _db.unregister(name)
    return got


def kept_counts(parts: DataFrame, least: int) -> DataFrame:
    """(shard, entries) to (shard, lang, term, source, n): counts of the terms in at least `least` documents of a language."""
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        entries = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in group.column("entries")])
        return _told(f"""WITH s AS (SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM entries GROUP BY ALL)
SELECT CAST({key[0].as_py()} AS int) AS shard, lang, term, source, CAST(n AS bigint) AS n FROM s QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}""", schema, entries=entries)

    return parts.groupBy("shard").applyInArrow(run, "shard int, lang string, term string, source string, n long")


def partial(kept: DataFrame, groups: DataFrame, told: int) -> DataFrame:
    """Kept counts and groups (shard, lang, source, total, v) to partial results (lang, source, part, item, value).

    Part `pair`: each source with those after it. Part `term`: the best `told` of a shard. A term that a group lacks has
    a share there as well.
    """
    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())])

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        if not counts.num_rows:
            return schema.empty_table()
        share = "CAST(1 + (1000000000::hugeint * ({n} + %d)) // ({total} + %d * v::hugeint) AS bigint)" % (ADDED, ADDED)
        return _told(f"""WITH t AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL), l AS (SELECT lang, sum(total) AS total FROM groups GROUP BY ALL),
grid AS MATERIALIZED (SELECT t.lang, t.term, g.source, coalesce(c.n, 0) AS n, {share.format(n='coalesce(c.n, 0)', total='g.total')} AS p, {share.format(n='t.n', total='l.total')} AS q
  FROM t JOIN l ON l.lang = t.lang JOIN groups g ON g.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.term = t.term AND c.source = g.source)
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p)) AS bigint) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL (SELECT lang, source, 'term', term, p - q FROM grid WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {told})""", schema, counts=counts, groups=groups)

    return kept.groupBy("shard").cogroup(groups.groupBy("shard")).applyInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, least: int = LEAST, told: int = TOLD) -> DataFrame:
    """(lang, source, text) to (lang, source, part, item, value, rank).

    Null texts, languages and sources are empty strings and count as such; repeated rows are documents of their own;
    texts of any length are read whole; equal values rank by item; a language whose terms are all too rare has values
    of 0; other columns are ignored; an empty table gives no rows. A shard takes the terms of about SHARD_DOCS documents, so
    that none grows with the table; the groups, of which the result holds all pairs, go to every shard.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    with common.Scratch(d.sparkSession) as scratch:
        groups = scratch.written(d.groupBy("lang", "source").agg(F.count("*").alias("docs")), "divergence-groups")
        shards = max(SHARDS, (groups.agg(F.sum("docs")).first()[0] or 0) // SHARD_DOCS)
        now = min(shards, FAN)
        parts = dealt(d, now)
        while now < shards:
            now *= min(FAN, -(-shards // now))
            parts = finer(parts, now, FAN * SPREAD)
        kept = scratch.written(kept_counts(parts, least), "divergence-counts")
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sizes = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("v"))
        known = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
        known = common.written(known, "divergence-totals")
        each = known.where("v > 0").select(F.explode(F.sequence(F.lit(0), F.lit(now - 1))).alias("shard"), "*")
        parts = common.written(partial(kept, each, told), "divergence-partial")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select(F.explode(F.array(F.struct("lang", "source", "item", "value"), F.struct("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("r")).select("r.*")
    pairs = known.select("lang", "source").join(known.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    best = parts.where("part = 'term'").withColumn("rank", by("lang", "source")).where(F.col("rank") <= told)
    return pairs.withColumn("rank", by("lang", "source")).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
