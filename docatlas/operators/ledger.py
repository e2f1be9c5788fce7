"""Documents with their sentences, pages and chunks, written as one: readers see all parts of a commit or none.

What a batch writes lies in folders of its own, which nothing reads until a commit names them. A commit is one small file,
whose number only one writer can take: of two that race, the second finds the number taken and goes on from the first one's state.
A document is what the last commit that has its key says; all its parts are those of that commit.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docatlas.indexes.home import filesystem

#: The tables of a store and the columns that tell whose a row is and where it stands.
PARTS = {"sentences": "doc_key string, ordinal int, page int, text string, words int", "pages": "doc_key string, page int, html string, first int, last int", "chunks": "doc_key string, ordinal int, text string"}
#: Versions of the documents and parts that are read one by one before they are to be folded.
FOLD = 50


class Taken(Exception):
    """Another writer has taken the number of this commit."""


def keyed(docs: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Documents (dataset, file_name, path?) with doc_key: that of a known document of the same dataset and file name, else of the only one of that file name, else a new one."""
    fresh = F.sha2(F.concat_ws("\u0001", F.coalesce("dataset", F.lit("")), "file_name"), 256)
    if old is None:
        return docs.withColumn("doc_key", fresh)
    by = Window.partitionBy("file_name")
    known = old.select("dataset", "file_name", F.col("doc_key").alias("known")).withColumn("n", F.count("*").over(by))
    same = known.select("dataset", "file_name", F.col("known").alias("same"))
    alone = known.where("n = 1").select("file_name", F.col("known").alias("alone"))
    got = docs.join(same, ["dataset", "file_name"], "left").join(alone, "file_name", "left")
    # A file name that two datasets of the batch share is no reason to take either for the known one.
    own = F.count("*").over(Window.partitionBy("file_name")) == 1
    return got.withColumn("doc_key", F.coalesce("same", F.when(own, F.col("alone")), fresh)).drop("same", "alone")


def found(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (file_path, dataset) to (file_path, dataset, doc_key): by dataset and file name, else by file name alone, else by the whole path as older rows have it; null if none is known."""
    name = F.element_at(F.split("file_path", r"[/\\]"), -1)
    rows = asked.select("file_path", "dataset", name.alias("file_name"))
    one = lambda keys, no: docs.groupBy(*keys).agg(F.min("doc_key").alias(f"k{no}"))
    rows = rows.join(one(["dataset", "file_name"], 1), ["dataset", "file_name"], "left").join(one(["file_name"], 2), "file_name", "left")
    whole = docs.groupBy(F.col("file_name").alias("file_path")).agg(F.min("doc_key").alias("k3"))
    return rows.join(whole, "file_path", "left").select("file_path", "dataset", F.coalesce("k1", "k2", "k3").alias("doc_key"))


def sentences(docs: DataFrame, said: Column, pages: Column) -> DataFrame:
    """(doc_key, ...) to sentences: blank ones are left out but keep their number; the page is told by even shares of the sentences, the last page takes the rest."""
    n, p = F.size(said), F.coalesce(pages, F.lit(1))
    share = F.when(p > 0, F.greatest(F.lit(1), F.floor(n / F.greatest(p, F.lit(1))).cast("int"))).otherwise(n)
    rows = docs.select("doc_key", share.alias("share"), p.alias("p"), F.posexplode(said).alias("i", "text")).where("trim(text) <> ''")
    page = F.when(F.col("p") > 0, F.least(F.floor(F.col("i") / F.col("share")).cast("int") + 1, F.col("p"))).otherwise(1)
    return rows.select("doc_key", (F.col("i") + 1).cast("int").alias("ordinal"), page.cast("int").alias("page"), "text", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("words"))


def pages(docs: DataFrame, said: Column, count: Column, html: Column) -> DataFrame:
    """(doc_key, ...) to a row a page: which sentences it covers, 0 and 0 where there are none, and the whole HTML on the first."""
    n = F.coalesce(F.size(said), F.lit(0))
    share = F.greatest(F.lit(1), F.floor(n / F.greatest(count, F.lit(1))).cast("int"))
    rows = docs.where(count > 0).select("doc_key", n.alias("n"), share.alias("share"), html.alias("html"), F.explode(F.sequence(F.lit(1), count)).alias("page"))
    some = F.col("n") > 0
    first, last = (F.col("page") - 1) * F.col("share") + 1, F.least(F.col("page") * F.col("share"), F.col("n"))
    return rows.select("doc_key", F.col("page").cast("int"), F.when(F.col("page") == 1, F.col("html")).alias("html"), F.when(some, first).otherwise(0).cast("int").alias("first"), F.when(some, last).otherwise(0).cast("int").alias("last"))


@dataclass
class Ledger:
    """A store at a path. documents: the schema of its documents, which has doc_key."""

    spark: SparkSession
    path: str
    documents: str

    def __post_init__(self) -> None:
        self.tables = {"documents": self.documents} | PARTS
        fs, at = filesystem(self.spark, f"{self.path}/commits")
        fs.mkdirs(at)

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        fs, at = filesystem(self.spark, f"{self.path}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()), default=0)

    def commit_of(self, version: int) -> list[dict]:
        """The folders that count at a version: [{batch, version}], the oldest first."""
        if not version:
            return []
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:012d}.json", wholetext=True).first().value)["batches"]

    def _publish(self, version: int, batches: list[dict]) -> None:
        """Takes a number for a commit; the file gets its name only when it is whole, and only if no other has it."""
        fs, folder = filesystem(self.spark, f"{self.path}/commits")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, target = path(folder, f".{uuid.uuid4().hex}"), path(folder, f"{version:012d}.json")
        out = fs.create(draft, False)
        out.write(json.dumps({"batches": batches}).encode())
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())  # a link is made or fails at once
                fs.delete(draft, False)
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
                none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(draft, target, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Taken(f"commit {version} is taken") from e
            raise

    def staged(self, **tables: DataFrame) -> str:
        """Writes a batch (documents and any of their parts) where no reader looks, and tells its name. Of a document that comes twice the row of the largest values counts."""
        batch = uuid.uuid4().hex
        cols = [f.name for f in self.spark.createDataFrame([], self.documents).schema]
        docs = tables["documents"].select(*cols)
        docs = docs.groupBy("doc_key").agg(F.max(F.struct(*(c for c in cols if c != "doc_key"))).alias("d")).select(*(("doc_key" if c == "doc_key" else f"d.{c}") for c in cols))
        docs.write.parquet(f"{self.path}/data/{batch}/documents")
        for name, rows in tables.items():
            if name != "documents":
                rows.write.parquet(f"{self.path}/data/{batch}/{name}")
        return batch

    def commit(self, batch: str, tables: list[str], based_on: int | None = None, tries: int = 20) -> int:
        """Makes a staged batch part of the store, whole, and gives the number of the commit.

        A batch replaces the documents whose keys it has, with all their parts. That holds whatever came before, so a
        writer whose number is taken tries the next one; with based_on, the version that the batch was worked out from, it
        raises Taken instead if that is no longer the last.
        """
        for _ in range(tries):
            last = self.version()
            if based_on is not None and last != based_on:
                raise Taken(f"the store is at {last}, not at {based_on}")
            try:
                self._publish(last + 1, [*self.commit_of(last), {"batch": batch, "version": last + 1, "tables": sorted({"documents", *tables})}])
                return last + 1
            except Taken:
                if based_on is not None:
                    raise
        raise Taken(f"no number was free in {tries} tries")

    def write(self, based_on: int | None = None, **tables: DataFrame) -> int:
        return self.commit(self.staged(**tables), list(tables), based_on)

    def _rows(self, name: str, batches: list[dict]) -> DataFrame:
        out = None
        for b in batches:
            if name in b["tables"]:
                rows = self.spark.read.schema(self.tables[name]).parquet(f"{self.path}/data/{b['batch']}/{name}").withColumn("_version", F.lit(b["version"]))
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], self.tables[name]).withColumn("_version", F.lit(0))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, by default the last one: each document, and each part of it, from the last commit that has the document."""
        batches = self.commit_of(self.version() if version is None else version)
        last = self._rows("documents", batches).groupBy("doc_key").agg(F.max("_version").alias("_version"))
        return self._rows(name, batches).join(last, ["doc_key", "_version"], "left_semi").drop("_version")

    def folded(self, least: int = FOLD) -> int:
        """Writes the last state as one batch once `least` have come together; older versions stay readable until cleared."""
        last = self.version()
        batches = self.commit_of(last)
        if len(batches) < least:
            return last
        batch = self.staged(**{n: self.read(n, last) for n in self.tables})
        self._publish(last + 1, [{"batch": batch, "version": last + 1, "tables": sorted(self.tables)}])
        return last + 1

    def cleared(self, older_than_ms: int) -> list[str]:
        """Deletes folders that the last commit does not name and that are older than a time, as killed writers and folds leave them; tells which."""
        fs, at = filesystem(self.spark, f"{self.path}/data")
        named = {b["batch"] for b in self.commit_of(self.version())}
        gone = [f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else []) if f.getPath().getName() not in named and f.getModificationTime() < older_than_ms]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)
