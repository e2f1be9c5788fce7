"""Typing errors, copies by key, places of words, and vectors, against plain Python over the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docatlas.indexes import vectors as V
from docatlas.operators import fuzzy
from docatlas.plans import analysis
from docatlas.sources import keysets

rng = random.Random(6)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_equal_all_pairs(spark):
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) for _ in range(220)} - {""})
    asked = rng.sample(words, 40) + ["zzzzzz", "a", "ab", "abc", "abcdefg"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, title string")
    _, left = fuzzy.index(rows, "id", ["title"])
    got = sorted((r.asked, r.word, r.distance) for r in fuzzy.near(left, spark.createDataFrame([(w,) for w in asked], "word string")).collect())
    most = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    assert got == sorted((a, w, distance(a, w)) for a in set(asked) for w in words if distance(a, w) <= most(a))


def test_best_field_counts(spark):
    rows = spark.createDataFrame([(1, "Moby Dick", "Melville"), (2, "Dick and Melvil", "nobody"), (3, None, "Herman Melville"), (4, "", None)], "id long, title string, author string")
    asked = spark.createDataFrame([("q", "mobi dick melvile"), ("none", "?"), ("far", "zebra")], "query_id string, text string")
    got = [tuple(r) for r in fuzzy.search(*fuzzy.index(rows, "id", ["title", "author"]), asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [("q", 1, 2, "title", round(1 + 1 - 1 / 7, 6)), ("q", 2, 1, "title", 1.75)]


def shuffled(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_equal_questions_and_rows_are_matched_once(spark):
    rows = spark.createDataFrame([(i, f"red bolt{i % 3 * 'x'}", "steel") for i in range(900)], "id long, title string, type string")
    asked = rows.where("id % 3 = 0").selectExpr("id as query_id", "'redd bolt steel' as text")
    before = shuffled(spark)
    got = fuzzy.search(*fuzzy.index(rows, "id", ["title", "type"]), asked, 5).orderBy("query_id", "rank").collect()
    assert shuffled(spark) - before < 30_000  # 270,000 pairs of a question and a row
    assert [tuple(r) for r in got] == [(q, n + 1, 3 * n, "title", 1.75) for q in range(0, 900, 3) for n in range(5)]


def test_a_copy_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(str(i), "x" if i % 9 == 0 else str(i), f"n{i}") for i in range(200)] + [(None, "1", "keyless"), ("7x", "2", "odd"), ("50", "5", "again")]
    df = spark.createDataFrame(rows, "id string, v string, name string").withColumn("k", F.col("id").try_cast("long"))
    parts = keysets.ranges(df, "k", 5)
    assert len(parts) == 5 and parts[0][0] is None and parts[-1][1] is None
    path, asked = f"file://{tmp_path}/copy", []

    def read(condition):
        asked.append(condition)
        if len(asked) == 3:
            raise RuntimeError("lost")
        return df.where(condition)

    schema = "id long, v int, name string"
    with pytest.raises(RuntimeError):
        keysets.copied(spark, read, "k", schema, parts, path, ["id"])
    (tmp_path / "copy" / "_draft-3").mkdir()  # what a lost writer left
    assert keysets.copied(spark, read, "k", schema, parts, path, ["id"]) == [2, 3, 4]
    assert keysets.copied(spark, read, "k", schema, parts, path, ["id"]) == []
    got = sorted((r.id, r.v, r["name"]) for r in keysets.rows(spark, path, schema).collect())
    want = sorted((int(i), None if v == "x" else int(v), n) for i, v, n in rows if i and i.isdigit())
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    told = keysets.rejects(spark, path, schema).collect()
    assert {r.row for r in told if r.left_out} == {'{"v":"1","name":"keyless"}', '{"id":"7x","v":"2","name":"odd"}'}
    assert sum(not r.left_out for r in told) == sum(v == "x" for _, v, _ in rows)


def test_ranges_of_few_keys(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,), (None,)], "k long")
    parts = keysets.ranges(df, "k", 4)
    assert sum(df.where(keysets.between("k", *p)).count() for p in parts) == 52
    none = df.limit(0)
    assert keysets.ranges(none, "k", 4) == [(None, None)] and df.where(keysets.between("k", None, None)).count() == 52


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_places_of_words(spark, most):
    rows = [(d, o, "The" if rng.random() < 0.5 else rng.choice(["a", "b", "c"])) for d in range(30) for o in range(12)]
    got = {r.word: (r.n, tuple(r["first"]), tuple(r["last"]), [tuple(p) for p in r.places]) for r in analysis.occurrences(spark.createDataFrame(rows, "doc_id long, ordinal int, word string").repartition(5), most).collect()}
    for w in {w.lower() for _, _, w in rows}:
        at = sorted((d, o) for d, o, x in rows if x.lower() == w)
        assert got[w] == (len(at), at[0], at[-1], at[:most])


def test_totals_of_books(spark):
    words = spark.createDataFrame([(1, "The"), (1, "cat,"), (1, "--"), (1, "the"), (2, "12"), (2, None)], "doc_id long, word string")
    known = spark.createDataFrame([("the",), ("the",), ("dog",)], "word string")
    n = spark.createDataFrame([(1, 2)], "doc_id long, sentences int")
    got = {r.doc_id: tuple(r)[1:] for r in analysis.totals(words, known, n).select("doc_id", "tokens", "content", "different", "defined", "undefined", "sentences", "coverage", "sentence_length").collect()}
    assert got == {1: (4, 3, 2, 2, 1, 2, round(200 / 3, 6), 1.5), 2: (2, 0, 0, 0, 0, 0, None, None)}


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    g = np.random.default_rng(3)
    centres = g.standard_normal((20, 24)) * 2
    x = (centres[g.integers(0, 20, 2000)] + g.standard_normal((2000, 24)) * 0.7).astype(np.float32)
    rows = [(i // 3, i % 3, v.tolist()) for i, v in enumerate(x)] + [(5000, 0, None), (5001, 0, [0.0] * 24), (5002, 0, [1.0]), (5003, 0, [float("nan")] * 24), (5004, 0, x[7].tolist()), (5004, 1, x[7].tolist())]
    path = f"file://{tmp_path_factory.mktemp('vectors')}/v"
    V.build(spark.createDataFrame(rows, "doc_id long, chunk int, embedding array<float>"), path)
    kept = [r for r in rows if r[2] and len(r[2]) == 24 and np.isfinite(r[2]).all() and any(r[2])]
    return V.Vectors(spark, path), kept


def exact(kept, q, k, by_document=False, only=None):
    q = np.array(q, float) / np.linalg.norm(q)
    far = [(round(1 - float(np.array(v, float) @ q / np.linalg.norm(np.array(v, float))), 9), d, c) for d, c, v in kept if only is None or d in only]
    if by_document:
        far = [min(x for x in far if x[1] == d) for d in {x[1] for x in far}]
    return sorted(far)[:k]


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<float>")


@pytest.mark.parametrize("by_document", [False, True])
def test_nearest_is_exact_without_probes(spark, clustered, by_document):
    ix, kept = clustered
    rows = [(i, kept[i * 90][2]) for i in range(5)] + [(90, None), (91, [0.0] * 24), (92, [1.0, 2.0])]
    got = {}
    for r in ix.nearest(asked(spark, rows), 12, by_document=by_document).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.doc_id, r.chunk))
    assert set(got) == set(range(5))
    for i in range(5):
        want = exact(kept, rows[i][1], 12, by_document)
        assert [x[0] for x in sorted(got[i])] == list(range(1, 13))
        assert [(d, c) for _, _, d, c in sorted(got[i])] == [(d, c) for _, d, c in want]


@pytest.mark.parametrize("by_document", [False, True])
def test_many_queries_are_asked_at_once(spark, clustered, monkeypatch, by_document):
    ix, kept = clustered
    scans, scanned = [], V.Vectors._scanned
    monkeypatch.setattr(V.Vectors, "_scanned", lambda self, q, *more: scans.append(len(q)) or scanned(self, q, *more))
    rows = [(i, kept[i * 4][2]) for i in range(300)]
    got = {}
    for r in ix.nearest(asked(spark, rows), 7, by_document=by_document).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.chunk))
    assert scans == [300, 300]
    assert all([x[1:] for x in sorted(got[i])] == [(d, c) for _, d, c in exact(kept, v, 7, by_document)] for i, v in rows)


def test_exact_search_leaves_cells_unread(clustered):
    ix, kept = clustered
    q = np.array([kept[4][2]], float)
    q /= np.linalg.norm(q)
    least = np.array([1 - exact(kept, q[0], 10)[-1][0]])
    assert ix.reachable(q, least).sum() < 0.5 * len(ix.cells[0])


def test_filtered_search(spark, clustered):
    ix, kept = clustered
    only = set(range(0, 600, 7))
    got = ix.nearest(asked(spark, [(1, kept[50][2])]), 9, only=spark.createDataFrame([(d,) for d in only], "doc_id long")).collect()
    assert [(r.doc_id, r.chunk) for r in sorted(got, key=lambda r: r["rank"])] == [(d, c) for _, d, c in exact(kept, kept[50][2], 9, only=only)]


def test_recall_with_calibrated_probes(spark, clustered):
    ix, kept = clustered
    rows = [(i, kept[i * 37 + 5][2]) for i in range(40)]
    probes = ix.calibrated(asked(spark, [(i, kept[i * 31][2]) for i in range(40)]), 10, 0.98)
    found = {}
    for r in ix.nearest(asked(spark, rows), 10, probes=probes).collect():
        found.setdefault(r.query_id, set()).add((r.doc_id, r.chunk))
    recall = np.mean([len(found[i] & {(d, c) for _, d, c in exact(kept, v, 10)}) / 10 for i, v in rows])
    q = np.array([v for _, v in rows], float)
    assert recall >= 0.95 and ix.share(q / np.linalg.norm(q, axis=1, keepdims=True), probes) <= 0.5


def test_no_vectors(spark, tmp_path):
    V.build(spark.createDataFrame([], "doc_id long, chunk int, embedding array<float>"), f"file://{tmp_path}/none")
    assert V.Vectors(spark, f"file://{tmp_path}/none").nearest(asked(spark, [(1, [1.0])]), 3).collect() == []
