"""Search over documents and their chunks: filters that compose, five metadata fields, chunk-level full text, fused tiers, pages.

Everything is a plan over DataFrames; a query is a small Python value. A chunk is a line of a document; its words are
runs of letters in lower case. Recency is the document's id. Words are looked up in a stored inverted index, substrings
through stored trigrams, fields in a stored table of metadata; each is built once for a state of the documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docatlas.functions import text as T
from docatlas.indexes import home, inverted, trigrams

# How many rows each tier and the merged result keep, and the constant of reciprocal ranks.
CAPS = {"filename": 2000, "field": 1000, "text": 5000, "vector": 2000, "merged": 50_000}
K = 60
FIELDS = ("title", "names", "terms", "dataset", "file_name")
#: What a choice of file types stands for; other files have no extension to ask for.
TYPES = {"pdf": ("pdf",), "spreadsheet": ("xlsx", "xls", "csv"), "video": ("mp4", "mov", "avi", "mkv", "wmv"), "audio": ("mp3", "wav", "m4a", "flac")}


@dataclass(frozen=True)
class Filters:
    """A conjunction of optional conditions; none at all keeps every row."""

    datasets: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    pages_from: int | None = None
    pages_to: int | None = None

    def condition(self) -> Column:
        """Names: each needle is in some name. A row without a date fails any date bound; both bounds are inclusive."""
        out = F.lit(True)
        if self.datasets:
            out &= F.col("dataset").isin(*self.datasets)
        if self.names:
            out &= T.names_all_match(F.col("names"), list(self.names))
        if self.extensions:
            out &= F.col("file_name").rlike(rf"(?i)\.({'|'.join(self.extensions)})$")
        if self.date_from:
            out &= F.coalesce(F.col("deduced") >= F.lit(self.date_from).cast("date"), F.lit(False))
        if self.date_to:
            out &= F.coalesce(F.col("deduced") <= F.lit(self.date_to).cast("date"), F.lit(False))
        if self.pages_from is not None:
            out &= F.coalesce("page_count", F.lit(0)) >= self.pages_from
        if self.pages_to is not None:
            out &= F.coalesce("page_count", F.lit(0)) <= self.pages_to
        return out

    def needs(self) -> set[str]:
        """Columns that the condition reads: what no filter asks for need not be joined."""
        used = {"dataset": self.datasets, "names": self.names, "file_name": self.extensions, "deduced": self.date_from or self.date_to, "page_count": self.pages_from is not None or self.pages_to is not None}
        return {c for c, on in used.items() if on}

    def fingerprint(self) -> str:
        """The same for filters that differ in the order of their lists only."""
        said = "|".join([",".join(sorted(self.datasets)), ",".join(sorted(self.names)), ",".join(sorted(self.extensions)), self.date_from or "", self.date_to or "", str(self.pages_from), str(self.pages_to)])
        return hashlib.sha256(said.encode()).hexdigest()[:32]


def extensions_of(chosen: list[str]) -> tuple[str, ...] | None:
    """Extensions of the chosen file types; null where all are chosen, as then nothing is to be filtered."""
    return None if set(chosen) >= set(TYPES) else tuple(e for t in chosen for e in TYPES.get(t, ()))


@dataclass(frozen=True)
class Query:
    text: str = ""
    exact: bool = False
    filters: Filters = field(default_factory=Filters)

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.lower().split()))

    def fingerprint(self) -> str:
        return hashlib.sha256(f"{self.text.lower()}|{self.exact}|{self.filters.fingerprint()}".encode()).hexdigest()[:32]


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The document view: title, names, terms, dataset, file name, pages and a deduced date (none for some)."""
    raw = spark.read.parquet(f"{d}/documents.parquet")
    n = F.col("doc_id")
    extension = F.get(F.array(*map(F.lit, ("pdf", "xlsx", "csv", "mp4", "txt"))), (n % 5).cast("int"))
    day = F.when(n % 7 != 0, F.date_add(F.lit("2000-01-01").cast("date"), (n % 9000).cast("int")))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 4)
    return raw.select("doc_id", "text", F.substring("text", 1, 60).alias("title"), F.array("source", "lang").alias("names"), F.slice(words, 1, 3).alias("terms"), F.col("source").alias("dataset"), F.concat(F.lit("DOC"), F.lpad(n.cast("string"), 8, "0"), F.lit("."), extension).alias("file_name"), F.ceil(F.col("n_chars") / 2000).cast("int").alias("page_count"), day.alias("deduced"))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, chunk): the lines of each document that hold anything."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "chunk")).where("chunk <> ''")


@dataclass(frozen=True)
class Stored:
    """What searches read: metadata of documents (with the head of their text), words of chunks, trigrams of texts."""

    spark: SparkSession
    source: str

    @property
    def documents(self) -> DataFrame:
        def build(path: str) -> None:
            documents(self.spark, self.source).select("*", F.substring("text", 1, 500).alias("head")).drop("text").write.parquet(path)

        return self.spark.read.parquet(home.once(self.spark, "metadata", f"{self.source}/documents.parquet", build))

    @property
    def words(self) -> inverted.Index:
        def build(path: str) -> None:
            docs = documents(self.spark, self.source)
            inverted.build(chunks(docs), path, docs.select("doc_id").distinct().count())

        return inverted.Index(self.spark, home.once(self.spark, "words", f"{self.source}/documents.parquet", build))

    @property
    def texts(self) -> trigrams.Trigrams:
        def build(path: str) -> None:
            trigrams.build(documents(self.spark, self.source).select(F.col("doc_id").alias("id"), F.col("text").alias("value")), path)

        return trigrams.Trigrams(self.spark, home.once(self.spark, "texts", f"{self.source}/documents.parquet", build))


def kept(stored: Stored, rows: DataFrame, filters: Filters) -> DataFrame:
    """Rows (doc_id, ...) of the documents that the filters keep; metadata are read only if a filter asks for any, and of them what it asks for."""
    needs = filters.needs()
    return rows.join(stored.documents.where(filters.condition()).select("doc_id"), "doc_id", "left_semi") if needs else rows


def in_metadata(docs: DataFrame, needle: str) -> DataFrame:
    """Documents of which a field holds the needle, whatever its case: title, names (as JSON), file name or dataset; % and _ in it stand for any characters."""
    fields = (F.col("title"), F.to_json("names"), F.col("file_name"), F.col("dataset"))
    hit = F.lit(False)
    for f in fields:
        hit |= F.coalesce(f.ilike(f"%{needle}%"), F.lit(False))
    return docs.where(hit)


def text_search(stored: Stored, q: Query, limit: int = 1000, metadata: str | None = None) -> DataFrame:
    """(doc_id, score, snippet): best score of the chunks that hold all words, or 0 for one that holds the text as it stands; 0.5 for a document whose metadata hold it. The largest counts."""
    words, docs = stored.words, stored.documents.where(q.filters.condition())
    scored = words.scores(q.words, words.weights(q.words))
    as_it_stands = stored.texts.candidates(q.text)
    rows = words.table("chunks")
    rows = rows if as_it_stands is None else rows.join(as_it_stands.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    like = rows.where(F.col("chunk").ilike(f"%{q.text}%")).select("part", "doc_id", "ordinal", F.lit(0.0).alias("score"))
    text = kept(stored, scored.unionByName(like), q.filters).groupBy("part", "doc_id").agg(F.max(F.struct("score", -F.col("ordinal"))).alias("b"))
    text = text.select("part", "doc_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("ordinal"))
    meta = in_metadata(docs, metadata or q.text).select(F.lit(None).cast("int").alias("part"), "doc_id", F.lit(0.5).alias("score"), F.lit(None).cast("int").alias("ordinal"))
    top = text.unionAll(meta).groupBy("doc_id").agg(F.max("part").alias("part"), F.max("score").alias("score"), F.max("ordinal").alias("ordinal"))
    top = words.with_text(top.orderBy(F.desc("score"), "doc_id").limit(limit), few=True)
    return top.join(docs.select("doc_id", "head"), "doc_id").select("doc_id", "score", F.coalesce(F.nullif("snippet", F.lit("")), "head").alias("snippet"))


def exact_search(stored: Stored, q: Query, metadata: str | None = None) -> DataFrame:
    """(doc_id): text or metadata hold the query as it stands, whatever its case; most recent first when paged."""
    text = stored.texts.containing(q.text).select(F.col("id").alias("doc_id"))
    meta = in_metadata(stored.documents.where(q.filters.condition()), metadata or q.text).select("doc_id")
    return kept(stored, text, q.filters).union(meta).distinct()


def recent(docs: DataFrame, limit: int) -> DataFrame:
    """The most recent documents of each dataset: as many of each as share the limit evenly, three at least; all without a limit."""
    if not limit:
        return docs
    n = docs.select("dataset").distinct().agg(F.greatest(F.lit(3), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.count("*")))).alias("most"))
    ranked = docs.withColumn("rn", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("doc_id"))))
    return ranked.join(F.broadcast(n), F.col("rn") <= F.col("most")).drop("rn", "most")


def names_tier(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, rank): documents whose file name holds the needle, at most CAPS['filename'] by recency."""
    hits = docs.where(F.contains(F.lower("file_name"), F.lit(needle.lower()))).orderBy(F.desc("doc_id")).limit(CAPS["filename"])
    return hits.select("doc_id", F.row_number().over(Window.orderBy(F.desc("doc_id"))).alias("rank"))


def fields_tier(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, rank): documents whose fields hold the needle, at most CAPS['field'] a field by recency; ranks run on from field to field. Documents are read once."""
    value = lambda name: F.array_join(name, " ") if name in ("names", "terms") else F.col(name)
    hits = F.array(*(F.when(F.contains(F.lower(value(name)), F.lit(needle.lower())), F.lit(i)) for i, name in enumerate(FIELDS)))
    rows = docs.select("doc_id", F.explode(F.array_compact(hits)).alias("field_no"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("field_no").orderBy(F.desc("doc_id")))).where(F.col("r") <= CAPS["field"])
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("field_no", F.desc("doc_id"))))  # 5,000 rows at most
    return ranked.groupBy("doc_id").agg(F.min("rank").alias("rank"))


def text_tier(stored: Stored, words: list[str]) -> DataFrame:
    """(doc_id, rank, n_chunks, snippet): documents by the number of their matching chunks."""
    return stored.words.tier(words, CAPS["text"])


def six_digits(n: Column) -> Column:
    """A number with six digits, rounded from its exact value; Java would round from the shortest decimal that tells it. For the few rows of a tier."""
    return F.udf(lambda x: None if x is None else f"{x:.6f}", "string", useArrow=False)(n)


def vector_tier(vectors: DataFrame, seed: int) -> DataFrame:
    """(doc_id, rank, snippet): vectors by distance to that of one id, which is read once and put into the plan."""
    got = vectors.where(F.col("vec_id") == seed).select("embedding").first()
    if got is None or got[0] is None:
        return vectors.where("false").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("rank"), F.lit("").alias("snippet"))
    q = [float(x) for x in got[0]]
    size = sum(x * x for x in q) ** 0.5
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    far = F.round(1 - dot(F.col("embedding"), F.lit(q)) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * size), 9)
    top = vectors.where("embedding is not null").select(F.col("vec_id").alias("doc_id"), far.alias("dist")).orderBy("dist", "doc_id").limit(CAPS["vector"])
    return top.select("doc_id", F.row_number().over(Window.orderBy("dist", "doc_id")).alias("rank"), F.concat(F.lit("distance "), six_digits(F.col("dist"))).alias("snippet"))


def merged(tiers: dict[int, DataFrame]) -> DataFrame:
    """Tiers (doc_id, rank, snippet?) to final ranks: sums of reciprocal ranks, each tier's rank, and the snippet of tier 3 before 4 before others."""
    told = None
    for no, t in sorted(tiers.items()):
        rows = t.select(F.lit(no).alias("tier"), "doc_id", "rank", (F.col("snippet") if "snippet" in t.columns else F.lit(None).cast("string")).alias("snippet"))
        told = rows if told is None else told.unionAll(rows)
    order = F.when(F.col("tier") == 3, 0).when(F.col("tier") == 4, 1).otherwise(2)
    ranks = [F.max(F.when(F.col("tier") == i, F.col("rank"))).alias(f"t{i}_rank") for i in sorted(tiers)]
    best = F.min_by(F.col("snippet"), F.when(F.col("snippet").isNotNull(), order))
    top = told.groupBy("doc_id").agg(F.round(F.sum(1 / (K + F.col("rank") + 1.0)), 9).alias("score"), *ranks, best.alias("snippet")).orderBy(F.desc("score"), "doc_id").limit(CAPS["merged"])
    return top.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


#: What the grammar tier looks for: kind, pattern, confidence.
GRAMMAR = (("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+", 0.9), ("day", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0.8), ("year", r"(?:19|20)[0-9]{2}", 0.5))


def grammar_tier(docs: DataFrame, rules: tuple[tuple[str, str, float], ...] = GRAMMAR) -> DataFrame:
    """(doc_id, rank, kind, position, confidence, snippet): of each document its most confident match, the first one of those, by code points from 1."""
    found = F.array(*(F.struct(F.lit(c).alias("confidence"), F.lit(k).alias("kind"), F.regexp_extract("text", p, 0).alias("snippet")) for k, p, c in rules))
    best = docs.select("doc_id", "text", F.get(F.filter(F.sort_array(found, asc=False), lambda x: x["snippet"] != ""), F.lit(0)).alias("m")).where("m is not null")
    rows = best.select("doc_id", F.col("m.kind").alias("kind"), F.instr("text", F.col("m.snippet")).alias("position"), F.col("m.confidence").alias("confidence"), F.col("m.snippet").alias("snippet"))
    order = [F.desc("confidence"), F.asc("position"), F.asc("doc_id")]
    return rows.orderBy(*order).limit(CAPS["text"]).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def relationships(nodes: list[int], vectors: DataFrame, k: int = 10, most: int = 200) -> DataFrame:
    """(source, target, similarity, rank): the k vectors most like that of each node on display, by cosine, the node itself aside.

    Nodes are a page of results, `most` at most; all vectors are compared with them in one pass, and only k of each task are shuffled.
    Null and zero vectors have no links; of a node's repeated vectors the greatest asks, a repeated target is linked row by row.
    """
    if len(set(nodes)) > most:
        raise ValueError(f"links are for at most {most} nodes at once")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("size", F.sqrt(dot(F.col("v"), F.col("v")))).where("size > 0 and size < double('Infinity')")
    one = unit.where(F.col("vec_id").isin(list(set(nodes)))).groupBy("vec_id").agg(F.max("v").alias("u"))
    asked = F.broadcast(one.select(F.col("vec_id").alias("source"), "u", F.sqrt(dot(F.col("u"), F.col("u"))).alias("usize")))
    pairs = unit.join(asked, F.col("vec_id") != F.col("source")).select("source", F.col("vec_id").alias("target"), F.round(dot(F.col("u"), F.col("v")) / (F.col("size") * F.col("usize")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("similarity"), "target"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def page(ranked: DataFrame, skip: int, take: int, ahead: int = 0) -> DataFrame:
    """Rows of one page by final_rank, with rows ahead for the next one marked, and how many there are in all (of those that a merge caps)."""
    rows = ranked.withColumn("total", F.count("*").over(Window.partitionBy()))
    rows = rows.where((F.col("final_rank") > skip) & (F.col("final_rank") <= skip + take + ahead))
    return rows.withColumn("ahead", F.col("final_rank") > skip + take)


def dispatched(stored: Stored, q: Query, skip: int = 0, take: int = 50, metadata: str | None = None) -> DataFrame:
    """(doc_id) of a page: recent documents for a blank query, matches of the text as it stands if it is exact, else text search by score."""
    if not q.text.strip():
        got, by = recent(stored.documents.where(q.filters.condition()), skip + take).select("doc_id"), [F.desc("doc_id")]
    elif q.exact:
        got, by = exact_search(stored, q, metadata), [F.desc("doc_id")]
    else:
        got, by = text_search(stored, q, skip + take, metadata), [F.desc("score"), F.asc("doc_id")]
    return got.orderBy(*by).offset(skip).limit(take).select("doc_id")


def hybrid(text: DataFrame, vectors: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, score, snippet, from_text): the best of two lists (doc_id, rank from 1, snippet) by reciprocal ranks.

    A document counts once a list, at its best rank there; on a collision the text's row stands for both.
    """
    one = lambda t, no: t.where(F.col("rank") <= max(limit, 100)).groupBy("doc_id").agg(F.min("rank").alias("rank"), F.min_by("snippet", "rank").alias("snippet")).select("doc_id", F.lit(no).alias("list"), "rank", "snippet")
    both = one(vectors, 0).unionAll(one(text, 1)).groupBy("doc_id").agg(F.round(F.sum(1 / (K + F.col("rank") + 0.0)), 9).alias("score"), F.max_by("snippet", "list").alias("snippet"), (F.max("list") == 1).alias("from_text"))
    return both.orderBy(F.desc("score"), "doc_id").limit(limit)


def matching_ids(stored: Stored, vectors: DataFrame, q: Query, seed: int) -> DataFrame:
    """(doc_id, final_rank): ids of the nearest vectors and of the best texts, fused."""
    best = text_search(stored, q, CAPS["vector"])
    text = best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))
    return merged({3: text, 4: vector_tier(vectors, seed).select("doc_id", "rank")}).select("doc_id", "final_rank")


def hydrated(ids: DataFrame, stored: Stored, words: list[str]) -> DataFrame:
    """(pos, doc_id) of a page to rows in that order, with the best chunk for a query and else the head of the text, its lines joined by blanks."""
    mine = stored.documents.join(F.broadcast(ids), "doc_id")
    index = stored.words
    best = index.with_text(index.counted(words, docs=ids), few=True).select("doc_id", "snippet")
    kind = F.when(F.col("file_name").endswith(".pdf"), "Pdf").when(F.col("file_name").endswith(".txt"), "Text").when(F.col("file_name").endswith(".msg"), "Email").otherwise("Image")
    return mine.join(best, "doc_id", "left").select("pos", "doc_id", kind.alias("kind"), "file_name", "dataset", "names", "page_count", "deduced", F.coalesce("snippet", F.replace("head", F.lit("\n"), F.lit(" "))).alias("snippet"))


def neighbourhoods(parts: DataFrame, hits: DataFrame, reach: int = 1) -> DataFrame:
    """hits (doc_id, ordinal, similarity) to the chunks around each, in order and joined, as one text a hit."""
    near = hits.select("doc_id", F.col("ordinal").alias("hit"), "similarity", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal"))
    rows = near.join(parts.select("doc_id", "ordinal", "chunk"), ["doc_id", "ordinal"])
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chunk"))), lambda x: x["chunk"]), "\n")
    return rows.groupBy("doc_id", "hit", "similarity").agg(said.alias("text"))


SAMPLE = Query("the of", filters=Filters(("src1", "src2", "src3", "src4", "src5")))
FILTER = Filters(datasets=("src1", "src2", "src3"), names=("SRC", "en"), extensions=("pdf", "CSV"), date_from="2000-01-05", date_to="2020-12-31", pages_from=1, pages_to=4)

def _merged(s: SparkSession, d: str, asked: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """The tiers of one search fused: file names, fields, text, vectors and grammar, or of them those asked for."""
    stored = Stored(s, d)
    tiers = {
        1: lambda: names_tier(stored.documents, "7"),
        2: lambda: fields_tier(stored.documents, "en"),
        3: lambda: text_tier(stored, ["of", "the"]),
        4: lambda: vector_tier(s.read.parquet(f"{d}/embeddings.parquet"), 0),
        5: lambda: grammar_tier(documents(s, d)).select("doc_id", "rank", "snippet"),
    }
    return merged({no: tiers[no]() for no in asked})


def _hits(s: SparkSession, d: str, words: list[str]) -> DataFrame:
    return Stored(s, d).words.matched(words).select("doc_id", "ordinal", F.col("hits").cast("int").alias("similarity"))


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    best = Stored(s, d).words.ranked(["of", "the"], 100)
    text = best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "snippet")
    return hybrid(text, vector_tier(s.read.parquet(f"{d}/embeddings.parquet"), 0))


def _ids(s: SparkSession, d: str) -> DataFrame:
    """Some documents in an order: the labelled ones of the lowest quality."""
    top = s.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q")).orderBy("q", F.desc("doc_id")).limit(200)
    return top.select("doc_id", F.row_number().over(Window.orderBy("q", F.desc("doc_id"))).alias("pos"))


QUERIES = {
    "search_filters": lambda s, d: documents(s, d).where(FILTER.condition()).select("doc_id", "file_name", "deduced", "page_count"),
    "search_best_chunk": lambda s, d: Stored(s, d).words.with_text(Stored(s, d).words.counted(["of", "the"])).select("doc_id", "n_chunks", F.col("hits").cast("int").alias("hits"), "snippet"),
    "search_text": lambda s, d: text_search(Stored(s, d), SAMPLE, metadata="src1"),
    "search_ranked": lambda s, d: Stored(s, d).words.ranked(["of", "the", "and"]).select("doc_id", "score", "snippet"),
    "search_phrase": lambda s, d: Stored(s, d).words.phrase(["of", "the"]).select("doc_id", "ordinal", F.size("places").alias("times"), F.get("places", F.lit(0)).alias("first")),
    "search_hybrid": _hybrid,
    "search_exact": lambda s, d: exact_search(Stored(s, d), Query("of the"), "src1"),
    "search_fields_tier": lambda s, d: fields_tier(Stored(s, d).documents, "en"),
    "search_text_tier": lambda s, d: text_tier(Stored(s, d), ["of", "the"]),
    "search_merged": _merged,
    "search_five_tiers": _merged,
    "search_page": lambda s, d: page(_merged(s, d, (2, 3)), 20, 30, 10).select("doc_id", "final_rank", "ahead", "total"),
    "search_recent": lambda s, d: recent(documents(s, d), 200).select("dataset", "doc_id"),
    "search_blank_page": lambda s, d: dispatched(Stored(s, d), Query(" "), 10, 20),
    "search_exact_page": lambda s, d: dispatched(Stored(s, d), Query("of the", True), 10, 20, "src1"),
    "search_neighbours": lambda s, d: neighbourhoods(Stored(s, d).words.table("chunks"), _hits(s, d, ["of", "the", "and"])),
    "search_hydrated": lambda s, d: hydrated(_ids(s, d), Stored(s, d), ["the"]).select("pos", "doc_id", "kind", "dataset", "snippet"),
    "sentences_joined": lambda s, d: chunks(documents(s, d)).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chunk"))), lambda x: x["chunk"]), " ").alias("joined"), F.max("ordinal").alias("last")),
    "substring_scan": lambda s, d: Stored(s, d).texts.containing("tion th").select(F.col("id").alias("doc_id")),
    "similar_file_names": lambda s, d: _file_names(s, d).similar("DOC00000042.csv", 0.5).select(F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity")),
}


def _file_names(s: SparkSession, d: str) -> trigrams.Trigrams:
    rows = lambda: documents(s, d).select(F.col("doc_id").alias("id"), F.col("file_name").alias("value"))
    return trigrams.Trigrams(s, home.once(s, "file-names", f"{d}/documents.parquet", lambda path: trigrams.build(rows(), path)))


_D = r"""WITH d AS (SELECT doc_id, text, substring(text, 1, 60) AS title, lower(source || ' ' || lang) AS names, [source, lang] AS names_raw, source AS dataset, lower(array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: len(w) > 4)[1:3], ' ')) AS terms,
  'DOC' || lpad(CAST(doc_id AS varchar), 8, '0') || '.' || CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'csv' WHEN 3 THEN 'mp4' ELSE 'txt' END AS file_name,
  CAST(ceil(n_chars / 2000.0) AS int) AS page_count, CASE WHEN doc_id % 7 <> 0 THEN CAST(DATE '2000-01-01' + CAST(doc_id % 9000 AS int) AS date) END AS deduced FROM documents),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
c AS (SELECT doc_id, u.i - 1 AS ordinal, ls[u.i] AS chunk, string_split_regex(lower(ls[u.i]), '[^\p{L}]+') AS ws FROM l, unnest(range(1, len(ls) + 1)) AS u(i) WHERE ls[u.i] <> ''),
m AS (SELECT doc_id, ordinal, chunk, len(list_filter(ws, lambda w: w IN ('of', 'the'))) AS hits FROM c WHERE list_contains(ws, 'of') AND list_contains(ws, 'the')),
b AS (SELECT doc_id, count(*) AS n_chunks, max(hits) AS hits, first(chunk ORDER BY hits DESC, ordinal) AS best FROM m GROUP BY doc_id),
f AS (SELECT doc_id, min(rank) AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY no, doc_id DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY doc_id DESC) AS k FROM (
  SELECT 0 AS no, doc_id FROM d WHERE lower(title) LIKE '%en%' UNION ALL SELECT 1, doc_id FROM d WHERE names LIKE '%en%' UNION ALL SELECT 2, doc_id FROM d WHERE terms LIKE '%en%'
  UNION ALL SELECT 3, doc_id FROM d WHERE lower(dataset) LIKE '%en%' UNION ALL SELECT 4, doc_id FROM d WHERE lower(file_name) LIKE '%en%') x) y WHERE k <= 1000) z GROUP BY doc_id),
t AS (SELECT doc_id, row_number() OVER (ORDER BY n_chunks DESC, doc_id) AS rank, n_chunks, substring(best, 1, 500) AS snippet FROM (SELECT * FROM b ORDER BY n_chunks DESC, doc_id LIMIT 5000) x),
v AS (SELECT doc_id, row_number() OVER (ORDER BY dist, doc_id) AS rank, 'distance ' || format('{:.6f}', dist) AS snippet FROM (SELECT e.vec_id AS doc_id, round(list_cosine_distance(CAST(e.embedding AS double[]), CAST(p.embedding AS double[])), 9) AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p WHERE e.embedding IS NOT NULL ORDER BY 2, 1 LIMIT 2000) x)"""
_META = "(title ILIKE '%src1%' OR '[\"' || names_raw[1] || '\",\"' || names_raw[2] || '\"]' ILIKE '%src1%' OR file_name ILIKE '%src1%' OR dataset ILIKE '%src1%')"
# Written from the rules: rarity, saturating counts, length, and the shortest stretch found by walking the places in order.
_SCORES = """, z AS (SELECT doc_id, ordinal, chunk, list_filter(ws, lambda w: w <> '') AS ws FROM c), n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM z),
p AS (SELECT doc_id, ordinal, len(ws) AS length, u.i - 1 AS pl, ws[u.i] AS word FROM z, unnest(range(1, len(ws) + 1)) AS u(i) WHERE ws[u.i] IN ({words})),
h AS (SELECT doc_id, ordinal FROM p GROUP BY 1, 2 HAVING count(DISTINCT word) = {m}),
i AS (SELECT word, ln(1 + (any_value(n.n) - count(DISTINCT (doc_id, ordinal)) + 0.5) / (count(DISTINCT (doc_id, ordinal)) + 0.5)) AS idf FROM p, n GROUP BY word),
g AS (SELECT p.doc_id, p.ordinal, p.word, count(*) * 2.2 / (count(*) + 1.2 * (0.25 + 0.75 * any_value(p.length) / any_value(n.mean))) * any_value(i.idf) AS gain FROM p JOIN h ON h.doc_id = p.doc_id AND h.ordinal = p.ordinal JOIN i ON i.word = p.word, n GROUP BY 1, 2, 3),
s1 AS (SELECT doc_id, ordinal, sum(gain) AS gain FROM g GROUP BY 1, 2),
e AS (SELECT p.doc_id, p.ordinal, p.pl, q.word, max(q.pl) AS last FROM p JOIN h ON h.doc_id = p.doc_id AND h.ordinal = p.ordinal JOIN p q ON q.doc_id = p.doc_id AND q.ordinal = p.ordinal AND q.pl <= p.pl GROUP BY 1, 2, 3, 4),
k1 AS (SELECT doc_id, ordinal, min(width) AS width FROM (SELECT doc_id, ordinal, pl - min(last) + 1 AS width FROM e GROUP BY doc_id, ordinal, pl HAVING count(*) = {m}) x GROUP BY 1, 2),
sc AS (SELECT s1.doc_id, s1.ordinal, round(gain * (1 + {m} / width) / 2, 6) AS score FROM s1 JOIN k1 ON k1.doc_id = s1.doc_id AND k1.ordinal = s1.ordinal)"""
_MERGE = """SELECT doc_id, score, t2_rank, t3_rank, snippet, row_number() OVER (ORDER BY score DESC, doc_id) AS final_rank FROM (
SELECT doc_id, round(sum(1 / (60 + rank + 1.0)), 9) AS score, max(CASE WHEN tier = 2 THEN rank END) AS t2_rank, max(CASE WHEN tier = 3 THEN rank END) AS t3_rank, first(snippet ORDER BY CASE tier WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END) FILTER (snippet IS NOT NULL) AS snippet
FROM (SELECT 2 AS tier, doc_id, rank, NULL AS snippet FROM f UNION ALL SELECT 3, doc_id, rank, snippet FROM t) x GROUP BY doc_id) y"""
_FIVE = r""", f1 AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM (SELECT doc_id FROM d WHERE lower(file_name) LIKE '%7%' ORDER BY doc_id DESC LIMIT 2000) x),
gr AS (SELECT doc_id, kind, snippet, confidence, instr(text, snippet) AS position FROM (SELECT doc_id, text, unnest([{'kind': 'mail', 'confidence': 0.9, 'snippet': regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+')}, {'kind': 'day', 'confidence': 0.8, 'snippet': regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')}, {'kind': 'year', 'confidence': 0.5, 'snippet': regexp_extract(text, '(?:19|20)[0-9]{2}')}], recursive := true) FROM documents) x WHERE snippet <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC) = 1),
f5 AS (SELECT doc_id, row_number() OVER (ORDER BY confidence DESC, position, doc_id) AS rank, snippet FROM gr QUALIFY rank <= 5000),
al AS (SELECT 1 AS tier, doc_id, rank, NULL AS snippet FROM f1 UNION ALL SELECT 2, doc_id, rank, NULL FROM f UNION ALL SELECT 3, doc_id, rank, snippet FROM t UNION ALL SELECT 4, doc_id, rank, snippet FROM v UNION ALL SELECT 5, doc_id, rank, snippet FROM f5)
SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS final_rank FROM (SELECT doc_id, round(sum(1 / (60 + rank + 1.0)), 9) AS score, max(rank) FILTER (tier = 1) AS t1_rank, max(rank) FILTER (tier = 2) AS t2_rank, max(rank) FILTER (tier = 3) AS t3_rank, max(rank) FILTER (tier = 4) AS t4_rank, max(rank) FILTER (tier = 5) AS t5_rank,
first(snippet ORDER BY CASE tier WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END) FILTER (snippet IS NOT NULL) AS snippet FROM al GROUP BY doc_id) y"""
_RECENT = "SELECT dataset, doc_id FROM (SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY doc_id DESC) AS rn FROM d) x WHERE rn <= greatest(3, {n} // (SELECT count(DISTINCT dataset) FROM d))"

ORACLES = {
    "search_filters": _D + " SELECT doc_id, file_name, deduced, page_count FROM d WHERE dataset IN ('src1', 'src2', 'src3') AND names LIKE '%src%' AND (dataset LIKE '%en%' OR string_split(names, ' ')[2] LIKE '%en%') AND regexp_matches(file_name, '[.](pdf|csv)$', 'i') AND deduced BETWEEN DATE '2000-01-05' AND DATE '2020-12-31' AND coalesce(page_count, 0) BETWEEN 1 AND 4",
    "search_best_chunk": _D + " SELECT doc_id, n_chunks, hits, substring(best, 1, 500) AS snippet FROM b",
    "search_text": _D + _SCORES.format(words="'of', 'the'", m=2) + f""", a AS (SELECT * FROM sc UNION ALL SELECT doc_id, ordinal, 0 FROM c WHERE chunk ILIKE '%the of%'), kd AS (SELECT * FROM d WHERE dataset IN ('src1', 'src2', 'src3', 'src4', 'src5')),
best AS (SELECT a.doc_id, max(score) AS score, first(chunk ORDER BY score DESC, a.ordinal) AS best FROM a JOIN c ON c.doc_id = a.doc_id AND c.ordinal = a.ordinal WHERE a.doc_id IN (SELECT doc_id FROM kd) GROUP BY 1),
both_ AS (SELECT doc_id, max(score) AS score, max(best) AS best FROM (SELECT * FROM best UNION ALL SELECT doc_id, 0.5, NULL FROM kd WHERE {_META}) x GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 1000)
SELECT both_.doc_id, score, substring(coalesce(nullif(best, ''), text), 1, 500) AS snippet FROM both_ JOIN kd ON kd.doc_id = both_.doc_id""",
    "search_ranked": _D + _SCORES.format(words="'of', 'the', 'and'", m=3) + " SELECT sc.doc_id, max(score) AS score, first(substring(chunk, 1, 500) ORDER BY score DESC, sc.ordinal) AS snippet FROM sc JOIN c ON c.doc_id = sc.doc_id AND c.ordinal = sc.ordinal GROUP BY 1",
    "search_phrase": _D + ", z AS (SELECT doc_id, ordinal, list_filter(ws, lambda w: w <> '') AS ws FROM c) SELECT doc_id, ordinal, CAST(count(*) AS int) AS times, CAST(min(u.i) - 1 AS int) AS first FROM z, unnest(range(1, len(ws))) AS u(i) WHERE ws[u.i] = 'of' AND ws[u.i + 1] = 'the' GROUP BY 1, 2",
    "search_hybrid": _D + _SCORES.format(words="'of', 'the'", m=2) + ", tb AS (SELECT sc.doc_id, max(score) AS score, first(substring(chunk, 1, 500) ORDER BY score DESC, sc.ordinal) AS snippet FROM sc JOIN c ON c.doc_id = sc.doc_id AND c.ordinal = sc.ordinal GROUP BY 1), tr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, snippet FROM tb) SELECT coalesce(v.doc_id, x.doc_id) AS doc_id, round(coalesce(1 / (60.0 + v.rank), 0) + coalesce(1 / (60.0 + x.rank), 0), 9) AS score, coalesce(x.snippet, v.snippet) AS snippet, x.doc_id IS NOT NULL AS from_text FROM (SELECT * FROM v WHERE rank <= 100) v FULL JOIN (SELECT * FROM tr WHERE rank <= 100) x ON x.doc_id = v.doc_id ORDER BY score DESC, 1 LIMIT 100",
    "search_five_tiers": _D + _FIVE,
    "substring_scan": "SELECT doc_id FROM documents WHERE text ILIKE '%tion th%'",
    "similar_file_names": _D + ", fg AS (SELECT doc_id, list_distinct(list_transform(range(1, len(file_name) + 2), lambda i: ('  ' || lower(file_name) || ' ')[i : i + 2])) AS g FROM d), q AS (SELECT list_distinct(list_transform(range(1, 17), lambda i: '  doc00000042.csv '[i : i + 2])) AS g) SELECT doc_id, round(len(list_intersect(fg.g, q.g)) / len(list_distinct(list_concat(fg.g, q.g))), 6) AS similarity FROM fg, q WHERE len(list_intersect(fg.g, q.g)) / len(list_distinct(list_concat(fg.g, q.g))) >= 0.5",
    "search_exact": _D + f" SELECT doc_id FROM d WHERE lower(text) LIKE '%of the%' OR {_META}",
    "search_fields_tier": _D + " SELECT doc_id, rank FROM f",
    "search_text_tier": _D + " SELECT doc_id, rank, n_chunks, snippet FROM t",
    "search_merged": _D + _FIVE,
    "search_page": _D + f", r AS ({_MERGE}) SELECT doc_id, final_rank, final_rank > 50 AS ahead, (SELECT count(*) FROM r) AS total FROM r WHERE final_rank > 20 AND final_rank <= 60",
    "search_recent": _D + " " + _RECENT.format(n=200),
    "search_blank_page": _D + f" SELECT doc_id FROM ({_RECENT.format(n=30)}) x ORDER BY doc_id DESC LIMIT 20 OFFSET 10",
    "search_exact_page": _D + f" SELECT doc_id FROM d WHERE lower(text) LIKE '%of the%' OR {_META} ORDER BY doc_id DESC LIMIT 20 OFFSET 10",
    "search_neighbours": _D + ", h AS (SELECT doc_id, ordinal AS hit, len(list_filter(ws, lambda w: w IN ('of', 'the', 'and'))) AS similarity FROM c WHERE list_contains(ws, 'of') AND list_contains(ws, 'the') AND list_contains(ws, 'and')) SELECT h.doc_id, hit, similarity, string_agg(chunk, chr(10) ORDER BY ordinal) AS text FROM h JOIN c ON c.doc_id = h.doc_id AND ordinal BETWEEN hit - 1 AND hit + 1 GROUP BY 1, 2, 3",
    "search_hydrated": _D + ", i AS (SELECT doc_id, row_number() OVER (ORDER BY q, doc_id DESC) AS pos FROM (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id ORDER BY q, doc_id DESC LIMIT 200) x), o AS (SELECT doc_id, first(chunk ORDER BY len(list_filter(ws, lambda w: w = 'the')) DESC, ordinal) AS best FROM c WHERE list_contains(ws, 'the') GROUP BY doc_id) SELECT pos, i.doc_id, CASE WHEN file_name LIKE '%.pdf' THEN 'Pdf' WHEN file_name LIKE '%.txt' THEN 'Text' ELSE 'Image' END AS kind, dataset, substring(coalesce(best, replace(text, chr(10), ' ')), 1, 500) AS snippet FROM i JOIN d ON d.doc_id = i.doc_id LEFT JOIN o ON o.doc_id = i.doc_id",
    "sentences_joined": _D + " SELECT doc_id, string_agg(chunk, ' ' ORDER BY ordinal) AS joined, max(ordinal) AS last FROM c GROUP BY doc_id",
}
