"""Writing documents and their parts, and coordinating searches: tables in, tables out, each step a merge by key.

A table here is a DataFrame that the caller writes where the old one was (or beside it and swaps): files are never changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import merge


def dimension(old: DataFrame, names: DataFrame, key: str, extra: list[str] = ()) -> DataFrame:
    """Rows (id, key, extras) of a dimension with those of `names` brought in: known keys keep their id and any extra that the batch lacks, new ones get a hash of the key as id."""
    batch = names.groupBy(key).agg(*(F.max(c).alias(f"new_{c}") for c in extra), F.lit(True).alias("_hit"))
    kept = old.join(batch, key, "left").select("id", key, *(F.coalesce(f"new_{c}", c).alias(c) for c in extra))
    fresh = batch.join(old.select(key), key, "left_anti").select(F.xxhash64(key).alias("id"), key, *(F.col(f"new_{c}").alias(c) for c in extra))
    return kept.unionByName(fresh)


def documents(old: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """Documents by key: a batch's newest row (by `at`) replaces what is there, but never puts null over a value."""
    new = merge.latest(batch, [key], ["at"])
    rest = [c for c in old.columns if c != key]
    both = old.select(key, *(F.col(c).alias(f"old_{c}") for c in rest)).join(new.select(key, *(F.col(c).alias(f"new_{c}") for c in rest)), key, "full")
    return both.select(key, *(F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in rest))


def replaced(old: DataFrame, batch: DataFrame, owner: str) -> DataFrame:
    """Parts of documents (sentences, pages, images): all parts of an owner that the batch has are put out, the batch's come in."""
    return old.join(batch.select(owner).distinct(), owner, "left_anti").unionByName(batch)


def sentences_of(docs: DataFrame, sentences: Column) -> DataFrame:
    """(doc_id, ...) to (doc_id, ordinal, sentence), blank ones left out, numbered without gaps."""
    kept = F.filter(F.transform(sentences, lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(kept).alias("ordinal", "sentence"))


def raw_or_shown(raw: Column, lines: Column, shown: Column) -> Column:
    """Which sentences a document has: its raw ones, else its raw lines, else its shown lines."""
    some = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, c)
    return F.coalesce(some(raw), some(lines), some(shown), F.array().cast("array<string>"))


def patched(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only the columns of `changes`, and only where they are not null, are changed; keys that the table lacks change nothing."""
    cols = [c for c in changes.columns if c != key]
    one = changes.groupBy(key).agg(*(F.max(c).alias(f"new_{c}") for c in cols))
    return old.join(one, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns))


def backfilled(old: DataFrame, vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Missing vectors from a batch; those that are there stay."""
    some = vectors.where(F.col(column).isNotNull()).groupBy(key).agg(F.first(column).alias("_new"))
    return old.join(some, key, "left").select(*(F.coalesce(c, "_new").alias(c) if c == column else F.col(c) for c in old.columns))


def write_mode(rows: int, existing: int, keyed: bool) -> str:
    """How a batch goes in: append to an empty table or one without key, ignore duplicates for large batches, merge for small ones."""
    return "append" if not existing or not keyed else "ignore" if rows * 10 >= existing else "merge"


def metadata_files(docs: DataFrame) -> DataFrame:
    """(file, body): a JSON document each, named after the document and its day; the largest id has a name that several share."""
    day = F.coalesce(F.date_format("deduced", "yyyy-MM-dd"), F.lit("UnknownDate"))
    name = F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit("_"), day, F.lit(".json"))
    return docs.select(name.alias("file"), "doc_id", F.to_json(F.struct("doc_id", "file_name", "title", "names", "terms", "dataset", "deduced", "page_count")).alias("body")).groupBy("file").agg(F.max_by("body", "doc_id").alias("body"))


def exported(saved: DataFrame, list_id: str) -> DataFrame:
    """The lines of one saved list as CSV, in its order, quotes doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = saved.where(F.col("list_id") == list_id)
    return rows.orderBy("pos").select(F.concat_ws(",", *(quoted(c) for c in saved.columns if c not in ("list_id", "pos"))).alias("line"))


def saved_list(saved: DataFrame, query: str, types: list[str] = ()) -> DataFrame | None:
    """Items of `list:<id>` in their order, of the active types only if there are any; None for any other query."""
    if not query.startswith("list:"):
        return None
    rows = saved.where(F.col("list_id") == query[5:])
    return (rows.where(F.col("type").isin(*types)) if types else rows).orderBy("pos")


# What a search has reached, by the tiers that are done.
STATUSES = ("Pending", "AllFast", "AllMedium", "AllDone")
#: Seconds that a search's results live.
TTL = 1800


def coordinated(searches: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Searches (hash, status, created, uses) with those asked (hash) at `now`: one row a hash however many ask at once.

    A live one is used once more; one past its time begins anew, as one that is not known.
    """
    wanted = asked.groupBy("hash").agg(F.count("*").alias("n"))
    both = searches.join(wanted, "hash", "full")
    live = F.col("created").isNotNull() & (F.col("created") + TTL > now)
    again = F.col("n").isNotNull() & ~live
    return both.select("hash", F.when(again, STATUSES[0]).otherwise(F.col("status")).alias("status"), F.when(again, now).otherwise(F.col("created")).alias("created"), (F.when(again, 0).otherwise(F.coalesce("uses", F.lit(0))) + F.coalesce("n", F.lit(0))).alias("uses"))


def advanced(searches: DataFrame, done: DataFrame) -> DataFrame:
    """Searches with the status that their finished tiers (hash, tier) tell: 1 and 2 fast, 3 medium, 4 all."""
    t = done.groupBy("hash").agg(F.collect_set("tier").alias("tiers"))
    has = lambda *x: F.size(F.array_intersect(F.coalesce("tiers", F.array().cast("array<int>")), F.array(*map(F.lit, x)))) == len(x)
    told = F.when(has(1, 2, 3, 4), STATUSES[3]).when(has(1, 2, 3), STATUSES[2]).when(has(1, 2), STATUSES[1]).otherwise(F.col("status"))
    return searches.join(t, "hash", "left").withColumn("status", told).select(*searches.columns)


def expired(searches: DataFrame, now: int) -> DataFrame:
    """Searches past their time: with their results they are to be deleted."""
    return searches.where(F.col("created") + TTL <= now)


def refined(versions: list[DataFrame]) -> DataFrame:
    """Results (doc_id, rank) of a search as its tiers come in: a later version's rank counts, what only an earlier one has stays behind all of those."""
    rows = None
    for i, v in enumerate(versions):
        part = v.select("doc_id", "rank", F.lit(i).alias("version"))
        rows = part if rows is None else rows.unionAll(part)
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("version", "rank"), "version").alias("x"))
    return last.select("doc_id", F.col("x.version").alias("version"), F.col("x.rank").alias("rank")).orderBy(F.desc("version"), "rank", "doc_id")


def unprocessed(files: DataFrame, done: DataFrame, by: str = "path") -> DataFrame:
    """Files that no marker (path, modified) tells as done, or that changed since."""
    return files.join(done.groupBy(by).agg(F.max("modified").alias("_done")), by, "left").where("_done is null or modified > _done").drop("_done")


def progressed(progress: DataFrame, table: str, last_id: int, rows: int) -> DataFrame:
    """Progress (table, last_id, rows) after one more step of a table; steps never go back."""
    step = progress.sparkSession.createDataFrame([(table, last_id, rows)], progress.schema)
    return progress.unionByName(step).groupBy("table").agg(F.max("last_id").alias("last_id"), F.sum("rows").cast("long").alias("rows"))


def conformed(df: DataFrame, ddl: str) -> DataFrame:
    """A table brought to a schema: columns that it lacks are null, others are cast, what the schema does not know goes."""
    from pyspark.sql import types as T

    wanted = T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def written_lists(lists: DataFrame, path: str) -> None:
    """Lists, a folder each, so that reading one list reads its folder only; a list that is written again replaces its folder alone."""
    lists.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list_id").parquet(path)


def registered(uploads: DataFrame, new: DataFrame) -> DataFrame:
    """A register of uploads (owner, digest, ...): what an owner has brought before is not brought in again."""
    return merge.insert_ignore(uploads, new, ["owner", "digest"])


def faceted(nodes: DataFrame, active: list[str]) -> DataFrame:
    """Nodes of the active types; all if none is active."""
    return nodes.where(F.col("type").isin(*active)) if active else nodes


def grid(df: DataFrame, filters: dict[str, str], order: list[tuple[str, bool]]) -> DataFrame:
    """Rows whose columns hold the filters' texts, whatever their case, in order of (column, descending)."""
    for column, needle in filters.items():
        df = df.where(F.contains(F.lower(F.col(column).cast("string")), F.lit(needle.lower())))
    return df.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order))
