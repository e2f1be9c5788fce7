"""Document fingerprints from invertible Bloom lookup sketches, in SQL functions only.

A text's paragraphs (lines, cut again after sentences) become 64-bit keys: 40 bits of a digest, 24 that check it. Keys
are dealt into buckets, and in its bucket's table each key is XORed into four cells. The tables are the fingerprint.
Two versions' tables subtract by XOR; peeling cells that hold one key recovers the keys in which the versions differ.
Where a bucket stalls, both texts are sketched again over four times as many buckets, until all is peeled.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells of a bucket (four parts of as many), keys that a bucket gets at most on average, sketches that are tried at most.
CELLS, PER_BUCKET, ATTEMPTS = 64, 20, 12
PART = CELLS // 4
#: Words of the bitmap that tells which texts a further sketch needs: 16 MB at most.
WORDS = 1 << 20
#: Ranges of ids for finding the next one: coarse ones by rank; each is split until a range has about so many ids.
COARSE, IDS = 64, 20_000
PARAGRAPH = r"(?<=[.!?])\s+|\n+"
_CHECK = (1 << 24) - 1


def checked(digest: Column) -> Column:
    """The key of a digest: its upper 40 bits and a check of them."""
    high = digest.bitwiseAND(F.lit(~_CHECK))
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit(_CHECK)))


def keys(text: Column) -> Column:
    """Distinct keys of a text's paragraphs; none for an empty text."""
    told = F.array_remove(F.array_distinct(F.transform(F.split(text, PARAGRAPH), lambda x: F.xxhash64(x))), F.xxhash64(F.lit("")))
    return F.array_distinct(F.transform(told, checked))


def buckets_for(n: Column, attempt: int = 0) -> Column:
    """Buckets for so many keys: as many as get PER_BUCKET each, four times as many each further attempt."""
    return (F.greatest(F.lit(1), F.ceil(n / PER_BUCKET)) * 4**attempt).cast("long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def mask(key: Column, attempt: int = 0) -> Column:
    """The four cells of a key, one in each part, as bits."""
    h = F.xxhash64(key, F.lit(attempt))
    at = [_bit(F.shiftrightunsigned(h, 16 * j).bitwiseAND(F.lit(PART - 1)).cast("int") + PART * j) for j in range(4)]
    return at[0].bitwiseOR(at[1]).bitwiseOR(at[2]).bitwiseOR(at[3])


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def peeled(cells: Column, attempt: int = 0) -> Column:
    """How many keys a subtracted table holds, or null where cells are left that no key explains.

    A round takes out all keys that are alone in a cell at once; as many rounds as there are cells are more than enough.
    """

    def alone(c: Column) -> Column:
        return (c != 0) & (F.xxhash64(c.bitwiseAND(F.lit(~_CHECK))).bitwiseAND(F.lit(_CHECK)) == c.bitwiseAND(F.lit(_CHECK)))

    def taken(s: Column, found: Column) -> Column:
        rest = F.transform(s.cells, lambda c, i: F.aggregate(found, c, lambda x, f: F.when(F.getbit(f.m, i) == 1, x.bitwiseXOR(f.k)).otherwise(x)))
        return F.struct(rest.alias("cells"), (s.n + F.size(found)).alias("n"), (F.size(found) == 0).alias("done"))

    def one(s: Column, _: Column) -> Column:
        told = F.transform(F.array_distinct(F.filter(s.cells, alone)), lambda k: F.struct(k.alias("k"), mask(k, attempt).alias("m")))
        return F.when(s.done, s).otherwise(_let(told, lambda found: taken(s, found)))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(CELLS)), start, one, lambda s: F.when(F.forall(s.cells, lambda c: c == 0), s.n))


def tables(rows: DataFrame, by: list[str], attempt: int = 0) -> DataFrame:
    """Rows (*by, key) to a table of cells for each group: sums by XOR, so that two versions' keys in one group leave their difference."""
    m = rows.withColumn("m", mask(F.col("key"), attempt))
    sums = [F.bit_xor(F.when(F.getbit("m", F.lit(i)) == 1, F.col("key")).otherwise(F.lit(0).cast("long"))).alias(f"c{i}") for i in range(CELLS)]
    return m.groupBy(*by).agg(*sums).select(*by, F.array(*(F.coalesce(f"c{i}", F.lit(0).cast("long")) for i in range(CELLS))).alias("cells"))


def said(cells: Column) -> Column:
    """A bucket's table as text: a mask of the cells that hold anything, and these, as base64 of 64-bit numbers."""
    full = F.aggregate(F.transform(cells, lambda c, i: F.when(c != 0, _bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    hexes = F.transform(F.concat(F.array(full), F.filter(cells, lambda c: c != 0)), lambda c: F.lpad(F.hex(c), 16, "0"))
    return F.base64(F.unhex(F.array_join(hexes, "")))


def read(fingerprint: str) -> list[list[int]]:
    """The tables of a fingerprint, bucket by bucket, as signed numbers."""
    out = []
    for part in fingerprint.split("."):
        raw = base64.b64decode(part)
        told = [int.from_bytes(raw[i : i + 8], "big", signed=True) for i in range(0, len(raw), 8)]
        rest = iter(told[1:])
        out.append([next(rest) if told[0] >> i & 1 else 0 for i in range(CELLS)])
    return out


def predecessors(ids: DataFrame) -> DataFrame:
    """Distinct ids (doc_id, ...) with the largest smaller id as next_id; the smallest has the largest of all.

    Windows run over ranges of ids, of which the first row looks at the last range before it that has any.
    """
    got = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.percentile_approx("doc_id", [i / COARSE for i in range(1, COARSE)], 1000)).first()
    low, high, n, inner = got[0], got[1], got[2], got[3]
    if n == 0:
        return ids.withColumn("next_id", F.col("doc_id"))
    edges = [low, *sorted({int(x) for x in inner if low < x < high}), high]
    fine = max(1, min(4096, n // (len(edges) * IDS) + 1))
    coarse = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("doc_id")))
    lo, hi = F.array(F.lit(low), *[F.lit(e) for e in edges]), F.array(F.lit(low), *[F.lit(e) for e in edges[1:]], F.lit(high))
    at = F.floor((F.col("doc_id") - F.get(lo, F.col("coarse"))) / F.greatest(F.lit(1), F.get(hi, F.col("coarse")) - F.get(lo, F.col("coarse"))) * fine)
    d = ids.withColumn("coarse", coarse).withColumn("range", F.col("coarse") * (fine + 2) + F.least(F.greatest(at, F.lit(0)), F.lit(fine))).drop("coarse")
    last = d.groupBy("range").agg(F.max("doc_id").alias("last")).withColumn("before", F.coalesce(F.lag("last").over(Window.orderBy("range")), F.lit(high))).select("range", "before")
    return d.withColumn("own", F.lag("doc_id").over(Window.partitionBy("range").orderBy("doc_id"))).join(F.broadcast(last), "range").withColumn("next_id", F.coalesce("own", "before")).drop("range", "own", "before")


def sides(d: DataFrame, order: DataFrame) -> DataFrame:
    """For each row of order (doc_id, n, next_id): digest of the edited text, and the keys of the text, the edited and the next one."""
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.floor(F.col("n") / 2).cast("int").alias("take"))
    given = d.join(asked.hint("shuffle_hash"), "doc_id").select(F.col("for_id").alias("doc_id"), F.substring("text", F.lit(1), F.col("take")).alias("head"), keys(F.col("text")).alias("kn"))
    n = F.length("text")
    whole = d.join(given, "doc_id").select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "head").alias("edited"), keys(F.col("text")).alias("ka"), "kn")
    return whole.select("doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), "ka", keys(F.col("edited")).alias("ke"), "kn")


def likened(whole: DataFrame, attempt: int = 0) -> DataFrame:
    """(doc_id, n_chars, sha, ka, ke, kn) to the result's columns; near_* is null where a bucket stalls.

    The rows of a document stay together by doc_id all the way, so that nothing is shuffled. Kinds of tables: 0 the
    text, 1 the edited one, 2 and 3 the text less the edited and the next one, over as many buckets as the larger of
    the two has in its fingerprint.
    """
    n = {k: buckets_for(F.size(f"k{k}"), attempt) for k in "aen"}
    whole = whole.select("*", *(c.alias(f"b{k}") for k, c in n.items())).select("doc_id", "n_chars", "sha", "ka", "ke", "kn", "ba", "be", F.greatest("ba", "be").alias("bae"), F.greatest("ba", "bn").alias("ban"))

    def dealt(kind: int, ks: str, of: str) -> Column:
        return F.transform(ks, lambda x: F.struct(F.lit(kind).alias("kind"), F.pmod(F.shiftrightunsigned(x, 24), F.col(of)).alias("bucket"), x.alias("key")))

    head = ["doc_id", "n_chars", "sha", "ba", "be", F.size("ka").alias("na"), F.size("ke").alias("ne"), F.size("kn").alias("nn")]
    some = F.concat(dealt(0, "ka", "ba"), dealt(1, "ke", "be"), dealt(2, "ka", "bae"), dealt(2, "ke", "bae"), dealt(3, "ka", "ban"), dealt(3, "kn", "ban"))
    by = ["doc_id", "n_chars", "sha", "ba", "be", "na", "ne", "nn"]
    rows = whole.select(*head, F.explode_outer(some).alias("x")).select(*by, "x.*")
    told = tables(rows, [*by, "kind", "bucket"], attempt)
    told = told.select(*by, "kind", "bucket", F.when(F.col("kind") < 2, said(F.col("cells"))).alias("said"), F.when(F.col("kind") >= 2, peeled(F.col("cells"), attempt)).alias("apart"))
    part = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("bucket", "said"))).alias(f"s{k}")
    sums = [x for k in (2, 3) for x in (F.sum(F.when(F.col("kind") == k, F.col("apart"))).alias(f"apart{k}"), F.count_if((F.col("kind") == k) & F.col("apart").isNull()).alias(f"stalled{k}"))]
    out = told.groupBy(*by).agg(part(0), part(1), *sums)
    like = lambda k, x, y: F.when(F.col(f"stalled{k}") == 0, F.when(F.col(x) + F.col(y) == 0, 1.0).otherwise(1 - F.coalesce(f"apart{k}", F.lit(0)) / (F.col(x) + F.col(y))))

    def joined(s: str, of: str) -> Column:
        held = F.map_from_entries(s)
        empty = F.base64(F.unhex(F.lit("0" * 16)))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col(of) - 1), lambda i: F.coalesce(F.try_element_at(held, i), empty)), ".")

    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), joined("s0", "ba").alias("fingerprint"), joined("s1", "be").alias("edited_fingerprint"), like(2, "na", "ne").alias("near_edited"), like(3, "na", "nn").alias("near_next"))


def sifted(d: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of d that may be among ids, before any of their text is shuffled: by a bitmap of hashes of at most 64 times WORDS bits, broadcast."""
    h = F.xxhash64("doc_id")
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(WORDS)), h.bitwiseAND(F.lit(63)).cast("int")
    bits = ids.select(word.alias("word"), _bit(bit).alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
    at = d.withColumn("at", word).withColumn("bit", bit)
    return at.join(F.broadcast(bits), (F.col("at") == F.col("word")) & (F.getbit("bits", F.col("bit")) == 1), "left_semi").drop("at", "bit")


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, attempts).

    The edited text has its last half replaced by the beginning of the next document's, in descending order of ids,
    the last one's next being the first. Likeness is 1 less the share of recovered differing keys among all of
    both; two texts without paragraphs are alike. attempts tells how many sketches it took: the first are the
    fingerprints returned, later ones have four times as many buckets each. A null text is empty; texts of any length
    are read whole. A doc_id that repeats counts once, with the smallest of its texts; rows without one are dropped;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    with common.Scratch(spark) as scratch:
        light = scratch.written(d.select("doc_id", F.length("text").alias("n")), "fingerprint-ids")
        if light.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
            d = d.groupBy("doc_id").agg(F.min("text").alias("text"))
            light = scratch.written(d.select("doc_id", F.length("text").alias("n")), "fingerprint-ids")
        order = scratch.written(predecessors(light), "fingerprint-order")
        got = common.written(likened(sides(d, order)), "fingerprints", "zstd")  # base64 packs well
        done = got.withColumn("attempts", F.lit(1))
        left = got.where("near_edited is null or near_next is null").select("doc_id")
        for attempt in range(1, ATTEMPTS):
            if not left.limit(1).count():
                return done
            again = scratch.written(order.join(left.hint("shuffle_hash"), "doc_id", "left_semi"), "fingerprint-left")
            some = sifted(d, again.select("doc_id").union(again.select("next_id")))
            got = common.written(likened(sides(some, again), attempt).select("doc_id", F.col("near_edited").alias("e"), F.col("near_next").alias("x")), "fingerprints-again")
            left = got.where("e is null or x is null").select("doc_id")
            fixed = got.where("e is not null and x is not null")
            done = done.join(fixed, "doc_id", "left").select(*done.columns[:5], F.coalesce("near_edited", "e").alias("near_edited"), F.coalesce("near_next", "x").alias("near_next"), F.when(F.col("e").isNotNull(), attempt + 1).otherwise(F.col("attempts")).alias("attempts"))
    raise RuntimeError(f"sketches of {ATTEMPTS} sizes stalled")
