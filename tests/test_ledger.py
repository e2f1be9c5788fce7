"""A store of documents and their parts: one commit for all, killed and racing writers, keys, pages."""

import threading

import pytest
from pyspark.sql import functions as F

from docatlas.operators import ledger as L

DOC = "doc_key string, dataset string, file_name string, title string"


@pytest.fixture
def store(spark, tmp_path):
    return L.Ledger(spark, f"file://{tmp_path}/store", DOC)


def batch(spark, docs, said):
    rows = L.keyed(spark.createDataFrame([(d, f, t) for d, f, t in docs], "dataset string, file_name string, title string"))
    texts = rows.withColumn("said", F.array(*map(F.lit, said)))
    return {"documents": rows.select("doc_key", "dataset", "file_name", "title"), "sentences": L.sentences(texts, F.col("said"), F.lit(2)), "pages": L.pages(texts, F.col("said"), F.lit(2), F.lit("<p>")), "chunks": texts.select("doc_key", F.lit(0).alias("ordinal"), F.array_join("said", " ").alias("text"))}


def seen(store, version=None):
    """Each document's title and the texts of its chunks and sentences."""
    docs = {r.doc_key: [r.file_name, r.title] for r in store.read("documents", version).collect()}
    for name in ("chunks", "sentences"):
        for k in docs:
            docs[k].append([])
        for r in store.read(name, version).orderBy("ordinal").collect():
            docs[r.doc_key][-1].append(r.text)
    return sorted(docs.values())


def test_all_parts_come_in_together(spark, store):
    assert store.version() == 0 and seen(store) == []
    assert store.write(**batch(spark, [("a", "x", "X"), ("a", "y", "Y")], ["one two", " ", "three"])) == 1
    assert store.write(**batch(spark, [("a", "x", "X2")], ["new"])) == 2
    assert seen(store) == [["x", "X2", ["new"], ["new"]], ["y", "Y", ["one two   three"], ["one two", "three"]]]
    assert seen(store, 1)[0] == ["x", "X", ["one two   three"], ["one two", "three"]]
    no_parts = {"documents": batch(spark, [("a", "y", "bare")], [])["documents"]}
    store.write(**no_parts)
    assert seen(store)[1] == ["y", "bare", [], []]  # its old sentences and chunks are gone


def test_a_killed_writer_leaves_nothing_to_see(spark, store):
    store.write(**batch(spark, [("a", "x", "X")], ["s"]))
    before = seen(store)
    staged = store.staged(**batch(spark, [("a", "x", "half"), ("a", "z", "Z")], ["t"]))  # and no commit
    assert seen(store) == before and store.version() == 1
    assert store.cleared(2**62) == [staged] and seen(store) == before


def test_racing_writers_leave_a_single_state(spark, store):
    staged = [store.staged(**batch(spark, [("a", "x", f"t{i}")], [f"s{i}"])) for i in range(4)]
    got, gate = [], threading.Barrier(4)

    def run(b):
        gate.wait()
        got.append(store.commit(b, ["sentences", "pages", "chunks"]))

    threads = [threading.Thread(target=run, args=(b,)) for b in staged]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [1, 2, 3, 4] and store.version() == 4
    (doc,) = seen(store)
    assert doc[1] == "t" + doc[2][0][1:] and doc[2] == doc[3]  # title, chunk and sentence of one writer
    assert len(store.commit_of(4)) == 4


def test_a_number_is_taken_once(spark, store):
    first, second = (store.staged(**batch(spark, [("a", "x", t)], [t])) for t in "pq")
    store._publish(1, [{"batch": first, "version": 1, "tables": ["documents", "sentences", "chunks"]}])
    with pytest.raises(L.Taken):
        store._publish(1, [{"batch": second, "version": 1, "tables": ["documents"]}])
    with pytest.raises(L.Taken):
        store.commit(second, ["sentences"], based_on=0)
    assert store.commit(second, ["sentences", "chunks"], based_on=1) == 2 and seen(store) == [["x", "q", ["q"], ["q"]]]


def test_folding_keeps_the_state(spark, store):
    for i in range(3):
        store.write(**batch(spark, [("a", f"f{i % 2}", f"t{i}")], [f"s{i}"]))
    before = seen(store)
    assert store.folded(5) == 3 and store.folded(3) == 4
    assert seen(store) == before and seen(store, 3) == before and len(store.commit_of(4)) == 1
    store.write(**batch(spark, [("a", "f1", "last")], ["x"]))
    assert seen(store)[1] == ["f1", "last", ["x"], ["x"]]


def test_a_document_that_comes_twice_counts_once(spark, store):
    store.write(**batch(spark, [("a", "x", "1"), ("a", "x", "2")], []))
    assert [r.title for r in store.read("documents").collect()] == ["2"]


def test_keys(spark):
    old = L.keyed(spark.createDataFrame([("a", "x", "p"), ("a", "y", "p"), ("b", "y", "p")], "dataset string, file_name string, title string"))
    key = {(r.dataset, r.file_name): r.doc_key for r in old.collect()}
    new = spark.createDataFrame([("a", "x", "1"), ("c", "x", "2"), ("c", "y", "3"), ("a", "z", "4")], "dataset string, file_name string, title string")
    got = {(r.dataset, r.file_name): r.doc_key for r in L.keyed(new, old).collect()}
    assert got["a", "x"] == key["a", "x"] and got["c", "y"] not in key.values() and len(set(got.values())) == 4
    one = {r.dataset: r.doc_key for r in L.keyed(new.where("title = '2'"), old).collect()}
    assert one["c"] == key["a", "x"]  # the only known file of that name
    docs = old.union(spark.createDataFrame([("old", "/data/w/v.pdf", "p", "k9")], "dataset string, file_name string, title string, doc_key string"))
    asked = spark.createDataFrame([("/d/x", "a"), ("/d/x", "q"), ("/data/w/v.pdf", "q"), ("/d/none", "a")], "file_path string, dataset string")
    assert {(r.file_path, r.dataset): r.doc_key for r in L.found(docs, asked).collect()} == {("/d/x", "a"): key["a", "x"], ("/d/x", "q"): key["a", "x"], ("/data/w/v.pdf", "q"): "k9", ("/d/none", "a"): None}


@pytest.mark.parametrize("said,count", [(list("abcdefg"), 3), (["a"], 4), ([], 2), (["a", " ", "b c"], 1), (["a"], 0)])
def test_pages_and_sentences(spark, said, count):
    rows = spark.createDataFrame([("k", said)], "doc_key string, said array<string>")
    share = max(1, len(said) // count) if count > 0 else len(said)
    want = [(i + 1, min(i // share + 1, count) if count > 0 else 1, len(s.split())) for i, s in enumerate(said) if s.strip()]
    assert [(r.ordinal, r.page, r.words) for r in L.sentences(rows, F.col("said"), F.lit(count)).orderBy("ordinal").collect()] == want
    n = len(said)
    cover = [(p, "<b>" if p == 1 else None, (p - 1) * share + 1 if n else 0, min(p * share, n) if n else 0) for p in range(1, count + 1)]
    assert [(r.page, r.html, r["first"], r["last"]) for r in L.pages(rows, F.col("said"), F.lit(count), F.lit("<b>")).orderBy("page").collect()] == cover
