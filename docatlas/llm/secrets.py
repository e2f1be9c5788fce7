"""Secret scans over an incremental blob ledger, in SQL functions only.

A version's content is addressed by its SHA-256. The ledger holds which rule versions have seen which blob and
what they found; only unseen pairs are scanned, each blob once however many paths hold it, and findings are
joined back to all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common

#: Rules: kind, version, pattern, the least characters of the group named next (0: the whole match).
RULES = (
    ("assign", 1, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    ("access", 1, r"AKIA[A-Z0-9]{14,}+", 18, 0),
    ("hex", 1, r"[0-9a-f]{16,}+", 16, 0),
    ("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
)
BASE = ("assign", "access", "hex")
#: Parts in which paths of one blob get its findings.
PARTS = 32
_FOUND = "array<struct<s:int,r:int,e:int,kind:string>>"
_MARK, _OTHER = "\ue000", "\ue001"


def spans(text: Column, rule: tuple, order: int) -> Column:
    """Matches of one rule as (s, r, e, kind), in code points: marks are put around them and what lies between is measured."""
    kind, _, pattern, least, group = rule
    marked = F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}")
    zero = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), F.array().cast(_FOUND).alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a.pos + F.length(p)
        ok = a.hit & (F.length(F.regexp_extract(p, pattern, group)) >= least if group else F.lit(True))
        one = F.array(F.struct(a.pos.alias("s"), F.lit(order).alias("r"), end.alias("e"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("pos"), (~a.hit).alias("hit"), F.when(ok, F.concat(a.out, one)).otherwise(a.out).alias("out"))

    return F.when(F.contains(marked, F.lit(_MARK)), F.aggregate(F.split(marked, _MARK), zero, step, lambda a: a.out)).otherwise(zero.out)


def scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """(doc_id, text), every row a version at a path, to (doc_id, blob, findings); brings the ledger at that path up to date.

    Without a ledger all blobs are unseen. A null text is the empty blob; texts of any length are scanned whole. A row
    without an id is a version at no known path, and scanned as any other. Of findings that begin at one place those of
    the rule listed first come first. Repeated rows give repeated results; other columns are ignored; an empty table
    gives no rows and leaves the ledger as it is.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), F.translate(whole, _MARK, _OTHER).alias("text"), F.unhex(F.sha2(whole, 256)).alias("blob"))
    paths = common.written(d.select("doc_id", "blob"), "blobs")
    names = [f"{kind}:{version}" for kind, version, *_ in RULES]
    schema = f"blob binary, rules array<string>, findings {_FOUND}"
    now = F.array(*map(F.lit, names))
    # the row that stands for a blob: the smallest id that has it, and rows without an id only where no other has it
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("at"), F.count("*").alias("n"))
    kept = ledger or common.fresh_path(spark, "ledger")
    seen = _ledger(docs, kept, schema) if ledger else None
    if seen is None:
        todo = blobs.withColumn("todo", now)
    else:
        seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(now, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("seen")
    todo = todo.withColumnRenamed("blob", "b").drop("n").hint("shuffle_hash")
    none = F.array().cast(_FOUND)
    found = F.concat(*(F.when(F.array_contains("todo", n), spans(F.col("text"), rule, i)).otherwise(none) for i, (n, rule) in enumerate(zip(names, RULES, strict=True))))
    fresh = d.join(todo, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("at")))
    fresh.select("blob", F.col("todo").alias("rules"), found.alias("findings")).write.mode("append").parquet(kept)
    current = F.create_map(*[F.lit(x) for kind, version, *_ in RULES for x in (kind, f"{kind}:{version}")])
    own = F.filter("findings", lambda x: F.array_contains("rules", current[x.kind]))  # not what older rule versions found
    known = spark.read.schema(schema).parquet(kept).where(F.size("findings") > 0).select("blob", own.alias("findings")).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    # a third of all paths may hold one blob: findings of a blob of several paths go to each part of them, of a single path to its own part
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")
    places = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(part("at")))
    dealt = known.join(blobs, "blob").select("blob", "findings", F.explode(places).alias("part"))
    return paths.withColumn("part", part("doc_id")).join(dealt, ["blob", "part"], "left").select("doc_id", "blob", F.coalesce("findings", none).alias("findings"))


def _ledger(docs: DataFrame, path: str, schema: str) -> DataFrame | None:
    try:
        return docs.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def told(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, findings) to counts and digests: by start, then by kind as listed."""
    kinds = F.array(*map(F.lit, BASE))
    count = lambda k: F.size(F.filter("findings", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(told(F.filter("findings", lambda x: F.array_contains(kinds, x.kind))), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"))


def redacted(text: Column, findings: Column, mask: str = "[SECRET]") -> Column:
    """text with what was found masked, from its end on; overlapping findings are masked as one."""
    keep = F.aggregate(findings, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, x: F.struct(F.greatest(a.at, x.e).alias("at"), F.when(x.s >= a.at, F.concat(a.out, text.substr(a.at + 1, x.s - a.at), F.lit(mask))).otherwise(a.out).alias("out")), lambda a: F.concat(a.out, text.substr(a.at + 1, F.length(text))))
    return F.when(F.size(findings) > 0, keep).otherwise(text)
