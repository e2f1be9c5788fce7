"""Stored indexes against plain Python over the same rows: whole results, odd rows, and what is read."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docatlas.indexes import home, inverted, trigrams
from docatlas.plans import search

rng = random.Random(3)
WORDS = "ant bee cat dog éclair fox gnu hen the of".split()
LINES = [(d, o, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14)))) for d in range(-5, 60) for o in range(rng.randint(1, 4))]
LINES += [(70, 0, None), (71, 0, ""), (72, 0, "... 12 !!"), (73, 0, "The CAT the Cat"), (74, 3, " ".join(["ant"] * 400 + ["bee"]))]


def split(line):
    return [w for w in re.split(r"[^a-zé]+", (line or "").lower()) if w]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/words"
    rows = spark.createDataFrame(LINES + LINES[:3], "doc_id long, ordinal int, chunk string")
    inverted.build(rows.withColumn("words", F.split(F.lower("chunk"), r"[^\p{L}]+")), path)
    return inverted.Index(spark, path)


def plain_counts(words):
    out = {}
    for d, o, line in LINES:
        c = Counter(split(line))
        if words and all(c[w] for w in words):
            hits = sum(c[w] for w in set(words))
            n, best, first = out.get(d, (0, 0, None))
            out[d] = (n + 1, max(best, hits), o if hits > best else first)
    return out


def plain_scores(words):
    bags = [(d, o, split(line)) for d, o, line in LINES]
    mean = sum(len(b) for _, _, b in bags) / len(bags)
    rare = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w in words for n in [sum(w in b for _, _, b in bags)]}
    best = {}
    for d, o, b in bags:
        if all(w in b for w in words):
            gain = sum(rare[w] * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in set(words))
            width = min(j - i + 1 for i in range(len(b)) for j in range(i, len(b)) if set(words) <= set(b[i : j + 1]))
            s = round(gain * (1 + len(set(words)) / width) / 2, 6)
            if d not in best or s > best[d][0]:
                best[d] = (s, (LINES[[(x, y) for x, y, _ in LINES].index((d, o))][2])[:500])
    return best


@pytest.mark.parametrize("words", [["the"], ["the", "of"], ["cat", "dog", "éclair"], ["zebra"], ["zebra", "the"], [], ["ant", "bee", "ant"]])
def test_counts_and_scores(index, words):
    got = {r.doc_id: (r.n_chunks, r.hits, r.ordinal) for r in index.counted(words).collect()}
    assert got == plain_counts(words)
    if words:
        want = plain_scores(words)
        assert {r.doc_id: (pytest.approx(r.score, abs=2e-6), r.snippet) for r in index.ranked(words).collect()} == want


@pytest.mark.parametrize("k", [1, 3, 20])
def test_bounds_leave_out_no_result(index, monkeypatch, k):
    whole = index.ranked(["the", "of"]).orderBy(F.desc("score"), "doc_id").limit(k).collect()
    counts = sorted(((-n, d) for d, (n, _, _) in plain_counts(["the", "of"]).items()))[:k]
    for name, v in (("PLAIN", 0), ("FIRST", 1)):
        monkeypatch.setattr(inverted, name, v)
    for listed in (5_000, 0):
        monkeypatch.setattr(inverted, "LISTED", listed)
        assert sorted(map(tuple, index.ranked(["the", "of"], k).collect())) == sorted(map(tuple, whole))
        assert sorted((r["rank"], r.doc_id, r.n_chunks) for r in index.tier(["the", "of"], k).collect()) == [(i, d, -n) for i, (n, d) in enumerate(counts, 1)]


def test_parts_of_low_bounds_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "PART", 2)
    monkeypatch.setattr(inverted, "PLAIN", 0)
    monkeypatch.setattr(inverted, "FIRST", 2)
    rows = spark.createDataFrame([(d, 0, "gnu " + "pad " * (200 if d > 3 else 0)) for d in range(40)], "doc_id long, ordinal int, chunk string")
    inverted.build(rows.withColumn("words", F.split("chunk", " ")), f"file://{tmp_path}/w")
    ix = inverted.Index(spark, f"file://{tmp_path}/w")
    idf = ix.weights(["gnu"])
    parts = ix.reachable(["gnu"], 1, lambda p: ix.scores(["gnu"], idf, p), idf)
    assert 0 < len(parts) < ix.table("totals").first().parts / 2
    assert [r.doc_id for r in ix.ranked(["gnu"], 1).collect()] == [0]


def test_no_task_gathers_a_word_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "PART", 4)
    rows = spark.createDataFrame([(d, 0, f"the w{d}") for d in range(200)], "doc_id long, ordinal int, chunk string")
    inverted.build(rows, f"file://{tmp_path}/w")
    files = inverted.Index(spark, f"file://{tmp_path}/w").of("postings", ["the"]).groupBy(F.input_file_name()).agg(F.sum("postings").alias("n")).collect()
    assert sum(r.n for r in files) == 200 and len(files) >= 10 and max(r.n for r in files) <= 50


def test_parts_are_dealt_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "PART", 4)
    inverted.build(spark.createDataFrame([(i, 0, "the cat") for i in range(160)], "doc_id long, ordinal int, chunk string"), f"file://{tmp_path}/w", 160)
    files = inverted.Index(spark, f"file://{tmp_path}/w").of("postings", ["the"]).groupBy(F.input_file_name()).agg(F.countDistinct("part").alias("parts")).collect()
    assert max(r.parts for r in files) <= inverted.GATHERED


def test_texts_and_words_are_dealt_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "PART", 4)
    monkeypatch.setattr(inverted, "LEXICON", 8)
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(160)]
    inverted.build(spark.createDataFrame([(i, 0, f"the {w}") for i, w in enumerate(names)], "doc_id long, ordinal int, chunk string"), f"file://{tmp_path}/w", 160)
    ix = inverted.Index(spark, f"file://{tmp_path}/w")
    files = ix.table("chunks").groupBy(F.input_file_name()).agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in files) == 160 and max(r.parts for r in files) <= inverted.GATHERED
    files = ix.table("words").groupBy(F.input_file_name(), "folder").agg(F.count("*").alias("n")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("n").alias("n")).collect()
    assert sum(r.n for r in files) == 161 and 1 < max(r.files for r in files) <= 5
    assert sorted((r.word, r.postings, r.docs) for r in ix.of("words", ["the", *names]).collect()) == sorted([("the", 160, 160), *((w, 1, 1) for w in names)])


def test_text_of_few_rows_comes_without_shuffling_the_others(spark, index):
    found = index.counted(["the"]).unionByName(spark.createDataFrame([(99, None, 0, 0, None)], "doc_id long, part int, n_chunks long, hits long, ordinal int"))
    got, want = (sorted(map(tuple, index.with_text(found, few=f).collect())) for f in (True, False))
    assert got == want and len(got) == len(plain_counts(["the"])) + 1
    for rows in (index.ranked(["the", "of"], 3), index.tier(["the", "of"], 3)):
        assert re.search(r"BroadcastHashJoin \[part#.*LeftSemi, BuildRight", rows._jdf.queryExecution().executedPlan().toString())


def test_counts_of_some_documents_shuffle_no_others(spark, index):
    rows = index.counted(["the"], docs=spark.createDataFrame([(d,) for d in (-5, 3, 70, 73, 1000, None)], "doc_id long"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and plan.rindex("Exchange hashpartitioning(part") < plan.index("LeftSemi")
    assert {r.doc_id: (r.n_chunks, r.hits, r.ordinal) for r in rows.collect()} == {d: v for d, v in plain_counts(["the"]).items() if d in (-5, 3, 70, 73)}


def test_rows_of_postings_are_cut_between_documents(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([r for r in LINES if r[2]], "doc_id long, ordinal int, chunk string")
    inverted.build(rows, f"file://{tmp_path}/w")
    whole = inverted.Index(spark, f"file://{tmp_path}/w")
    chunks = whole.table("chunks").select("part", "doc_id", "ordinal", F.filter(inverted.words_of(F.col("chunk")), lambda w: w != "").alias("words")).orderBy("part", "doc_id", "ordinal").toArrow()
    monkeypatch.setattr(inverted, "WORDS", 50)
    got = [r for b in inverted.gathered(iter(chunks.to_batches(max_chunksize=3)), 5.0) for r in b.to_pylist() if r["word"] == "the"]
    want = whole.of("postings", ["the"]).collect()
    assert len(got) > 3 and sum(r["docs"] for r in got) == sum(r.docs for r in want) and max(r["most"] for r in got) == max(r.most for r in want)
    assert sorted((x["doc_id"], x["ordinal"], x["gaps"]) for r in got for x in r["held"]) == sorted((x.doc_id, x.ordinal, x.gaps) for r in want for x in r.held)


def test_a_very_long_chunk_is_scored(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "the of " * 60_000)], "doc_id long, ordinal int, chunk string")
    inverted.build(rows, f"file://{tmp_path}/w")
    ix = inverted.Index(spark, f"file://{tmp_path}/w")
    assert len(ix.ranked(["the", "of"]).collect()) == 1 and [len(r.places) for r in ix.phrase(["the", "of"]).collect()] == [60_000]


def test_phrases(index):
    for words in (["the", "of"], ["cat"], ["ant", "ant", "bee"], ["the", "zebra"], []):
        want = {}
        for d, o, line in LINES:
            b = split(line)
            at = [i for i in range(len(b)) if words and b[i : i + len(words)] == words]
            if at:
                want[d, o] = at
        assert {(r.doc_id, r.ordinal): r.places for r in index.phrase(words).collect()} == want


def test_queries_read_folders_of_their_words_only(index):
    plan = index.counted(["the"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and "PushedFilters" in plan and "chunk#" not in plan
    one = index.of("postings", ["the"]).select(F.input_file_name()).distinct().count()
    assert one < index.table("postings").select(F.input_file_name()).distinct().count()


def test_an_empty_table_has_an_index(spark, tmp_path):
    trigrams.build(spark.createDataFrame([], "id long, value string"), f"file://{tmp_path}/empty")
    assert trigrams.Trigrams(spark, f"file://{tmp_path}/empty").containing("abc").collect() == []
    inverted.build(spark.createDataFrame([], "doc_id long, ordinal int, chunk string, words array<string>"), f"file://{tmp_path}/none")
    ix = inverted.Index(spark, f"file://{tmp_path}/none")
    assert ix.ranked(["the"], 5).collect() == [] and ix.tier(["the"], 5).collect() == [] and ix.phrase(["the"]).collect() == []


NAMES = [(i, "".join(rng.choice("abcé_% ") for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(500, None), (501, ""), (502, "ab"), (503, "x" * 5000 + "Needle"), (7, "second of 7")]


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/names"
    trigrams.build(spark.createDataFrame(NAMES, "id long, value string"), path)
    return trigrams.Trigrams(spark, path)


def test_pieces_of_a_part_give_the_same_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "PIECE", 40)
    trigrams.build(spark.createDataFrame(NAMES, "id long, value string"), f"file://{tmp_path}/n")
    cut = trigrams.Trigrams(spark, f"file://{tmp_path}/n")
    assert cut._of("lists", ["  a"]).select("piece").distinct().count() > 3
    for needle in ("abc", "needle", "b_b", "second of"):
        assert sorted(map(tuple, cut.containing(needle).collect()), key=repr) == sorted(((i, v) for i, v in NAMES if like(needle, v)), key=repr)


def test_no_task_gathers_a_trigram_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "PART", 10)
    trigrams.build(spark.createDataFrame([(i, f"abc {i}") for i in range(200)], "id long, value string"), f"file://{tmp_path}/n")
    files = trigrams.Trigrams(spark, f"file://{tmp_path}/n")._of("lists", ["abc"]).groupBy(F.input_file_name()).agg(F.sum(F.size("ids")).alias("n")).collect()
    assert sum(r.n for r in files) == 200 and len(files) > 4 and max(r.n for r in files) < 100, files


def like(needle, value):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in needle)
    return value is not None and re.search(pattern, value, re.I | re.S) is not None


@pytest.mark.parametrize("needle", ["abc", "ABC", "needle", "xxxxNEEDLE", "zzz", "ab", "", "é a", "a%bcé", "ab_cab", "b_b", "second of"])
def test_substrings_equal_a_scan(names, needle):
    assert sorted(map(tuple, names.containing(needle).collect()), key=repr) == sorted(((i, v) for i, v in NAMES if like(needle, v)), key=repr)


def test_random_substrings_equal_a_scan(names):
    for _ in range(8):
        v = rng.choice([v for _, v in NAMES if v and 4 <= len(v) < 20])
        a = rng.randint(0, len(v) - 4)
        needle = v[a : a + rng.randint(3, 5)]
        assert sorted(r.id for r in names.containing(needle).collect()) == sorted(i for i, x in NAMES if like(needle, x))


def grams(s):
    s = f"  {s.lower()} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


@pytest.mark.parametrize("least", [0.1, 0.3, 0.6, 1.0])
def test_similarity_equals_a_scan(names, least):
    for text in ("abc abc", "x", "second of seven"):
        want = {(i, v): len(grams(v) & grams(text)) / len(grams(v) | grams(text)) for i, v in NAMES if v is not None}
        assert {(r.id, r.value): round(r.similarity, 9) for r in names.similar(text, least).collect()} == {k: round(s, 9) for k, s in want.items() if s >= least}


def test_few_rows_are_read(names):
    assert names.candidates("needle").count() == 1 and names.candidates("zzzq").count() == 0 and names.candidates("ab") is None


def test_an_index_follows_its_source(spark, tmp_path):
    source, made = f"file://{tmp_path}/t.parquet", []

    def build(path):
        made.append(path)
        spark.read.parquet(source).write.parquet(path)

    spark.range(3).write.parquet(source)
    first = home.once(spark, "test", source, build)
    assert home.once(spark, "test", source, build) == first and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    second = home.once(spark, "test", source, build)
    assert second != first and spark.read.parquet(second).count() == 5 and spark.read.parquet(first).count() == 3


def test_one_that_comes_second_is_put_out(spark, tmp_path):
    source = f"file://{tmp_path}/s.parquet"
    spark.range(2).write.parquet(source)

    def late(path):
        home.once(spark, "race", source, lambda p: spark.range(7).write.parquet(p))
        spark.range(9).write.parquet(path)

    got = home.once(spark, "race", source, late)
    assert spark.read.parquet(got).count() == 7


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(1, "Alpha one " + "pad " * 20 + "\nmore of the text", "Bo", "en", 30), (2, "plain of the\nof it", "ds9", "de", 20), (3, "nothing", "src", None, 7), (4, "100% sure", "x_y", "fr", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    return search.Stored(spark, f"file://{tmp_path}")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_metadata_match_field_by_field(stored):
    exact = lambda q: ids(search.exact_search(stored, search.Query(q, True)))
    assert exact("one bo") == []  # ends of two fields are no match
    assert exact("ds9") == [2] and exact("DOC00000003") == [3] and exact('"x_y"') == [4]
    assert exact("of the") == [1, 2] and exact("n_thing") == [3] and exact("0% s") == [4]
    only = search.Query("of the", True, search.Filters(datasets=("ds9",)))
    assert ids(search.exact_search(stored, only)) == [2]


def test_text_search_scores(stored):
    got = {r.doc_id: (r.score, r.snippet) for r in search.text_search(stored, search.Query("the of")).collect()}
    assert set(got) == {1, 2} and all(s > 0 for s, _ in got.values()) and got[2][1] == "plain of the"
    got = {r.doc_id: r.score for r in search.text_search(stored, search.Query("ore o")).collect()}
    assert got == {1: 0.0}  # holds it as it stands, but no such words
    assert {r.doc_id: r.score for r in search.text_search(stored, search.Query("ds9")).collect()} == {2: 0.5}


def test_filters_that_ask_for_nothing_join_nothing(stored):
    rows = stored.spark.range(3).withColumnRenamed("id", "doc_id")
    assert search.kept(stored, rows, search.Filters()) is rows
    assert search.Filters(extensions=("pdf",), date_from="2000-01-01").needs() == {"file_name", "deduced"}


def test_hybrid_takes_the_best_rank_and_the_text_on_collision(spark):
    text = spark.createDataFrame([(1, 1, "t1"), (2, 2, "t2"), (1, 5, "later")], "doc_id long, rank int, snippet string")
    vectors = spark.createDataFrame([(2, 1, "v2"), (3, 2, "v3"), (3, 3, "v3b"), (2, 9, "v2b")], "doc_id long, rank int, snippet string")
    got = {r.doc_id: (r.score, r.snippet, r.from_text) for r in search.hybrid(text, vectors).collect()}
    assert got == {1: (round(1 / 61, 9), "t1", True), 2: (round(1 / 62 + 1 / 61, 9), "t2", True), 3: (round(1 / 62, 9), "v3", False)}


def test_six_digits_are_rounded_from_the_exact_value(spark):
    got = spark.createDataFrame([(0.8650395,), (0.5,), (None,)], "x double").select(search.six_digits(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == ["0.865039", "0.500000", None]
