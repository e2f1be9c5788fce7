import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docatlas.operators import wordlists as W
from docatlas.plans import analysis

rng = random.Random(8)
ODD = ["The the THE,", "--a--b-- (x) 12 a1b", "", None, " \n ", "a\rb\r \t c", "Über über, ΣΑΣ İx é ́e", "𝒜b 12𝒜 ab9 9", "the  the\n\nthe the cat", "no-one's x--y --", "." * 50 + "q" + "7" * 50]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choice(["the", "The", "cat,", "(dog)", "1", "\n", "--"]) for _ in range(60))) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).cache()


def words(text):
    return [w for w in (text or "").replace("\n", " ").split(" ") if w]


def test_lists_hold_each_word_once_a_slice(spark):
    rows = W.lists(spark.createDataFrame([(i, "the the cat") for i in range(500)], "doc_id long, text string").coalesce(1)).collect()
    assert {r.word: [tuple(x) for x in r.held] for r in rows} == {"the": [(i, 2) for i in range(500)], "cat": [(i, 1) for i in range(500)]} and len(rows) == 2


def test_slices_are_small_and_whole(monkeypatch):
    monkeypatch.setattr(W, "SLICE", 10)
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": ["abc", None, "abcdef", "x" * 40, "", "yz"]})
    got = list(W._sliced(iter([b, b.slice(0, 0)])))
    assert [x.column("doc_id").to_pylist() for x in got] == [[0, 1, 2], [3], [4, 5]]


@pytest.mark.parametrize("most", [1, 3, 500])
def test_places_of_texts(docs, most):
    got = {r.word: (r.n, tuple(r["first"]), tuple(r["last"]), [tuple(p) for p in r.places]) for r in W.merged(W.places(docs, most), most).collect()}
    want = {}
    for i, t in sorted(ROWS):
        for o, w in enumerate(words(t)):
            want.setdefault(w if not w.isascii() else w.lower(), []).append((i, o))
    plain = {w for w in want if w.isascii()}
    assert {w for w in got if w.isascii()} == plain and all(got[w] == (len(want[w]), want[w][0], want[w][-1], want[w][:most]) for w in plain)


def test_places_of_repeated_ids(spark):
    twice = spark.createDataFrame([(1, "a b a"), (1, "b a a"), (0, "b")], "doc_id long, text string").coalesce(1)
    got = {r.word: (r.n, [tuple(p) for p in r.places]) for r in W.merged(W.places(twice, 3), 3).collect()}
    assert got == {"a": (4, [(1, 0), (1, 1), (1, 2)]), "b": (3, [(0, 0), (1, 0), (1, 1)])}


@pytest.mark.parametrize("more", [[], [(0, "again the cat"), (3, "x")]])
def test_totals_of_texts_equal_totals_of_words(spark, docs, more):
    docs = docs.unionAll(spark.createDataFrame(more, docs.schema))
    known = spark.createDataFrame([("the",), ("the",), ("dog",), ("über",)], "word string")
    sentences = docs.select("doc_id", F.size(analysis.T.sentences(F.col("text"))).alias("sentences"))
    one, two = analysis.totals_of_texts(docs, known), analysis.totals(analysis._tokens(docs), known, sentences)
    assert one.dtypes == two.dtypes
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("books"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("The dog, a cat",)], "text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_looked_up_by_lists(spark, folder):
    got = analysis.QUERIES["lemma_hits"](spark, folder)
    assert "MapInArrow" in plan(got)
    letters = lambda t: ["".join(c for c in w if c.isalpha()) for w in words(t)]
    want = {i: sum(w.lower() in ("the", "dog", "a", "cat") for w in letters(t)) for i, t in ROWS if i >= 100}
    assert {r.doc_id: r.n for r in got.where("doc_id >= 100").collect()} == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("query", ["vocabulary_places", "book_totals"])
def test_words_are_not_shuffled_one_by_one(spark, folder, query):
    assert "posexplode" not in plan(analysis.QUERIES[query](spark, folder))
