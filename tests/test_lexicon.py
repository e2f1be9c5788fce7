import math
import re

import pytest
from pyspark.sql import functions as F

from docatlas.functions import splitting as S, text as T
from docatlas.operators import wordsplit
from docatlas.operators import lexicon as L
from docatlas.plans import language


@pytest.fixture(scope="module")
def senses(spark):
    rows = [("run", "1", "Move fast on foot. verb."), ("fast", "1", "At speed. adverb."), ("apple", "1", "A round fruit. noun."), ("speed", "1", "a rate. noun.")]
    return spark.createDataFrame(rows, "headword string, sense_id string, text string")


@pytest.fixture(scope="module")
def synonyms(spark):
    return spark.createDataFrame([("run", None, "sprint"), ("fast", "1", "rapid")], "headword string, sense_id string, other string")


def test_distances_over_three_kinds_of_edges(spark, senses, synonyms):
    want = {("run", "sprint"): 1, ("run", "foot"): 1, ("run", "fast"): 1, ("fast", "rapid"): 1, ("run", "rapid"): 2, ("apple", "run"): -1, ("run", "run"): 0}
    pairs = spark.createDataFrame(list(want), "source string, target string")
    got = {(r.source, r.target): r.distance for r in L.semantic_distances(pairs, senses, synonyms, 5).collect()}
    assert got == want


def test_entries(spark):
    raw = "1. () A thing. a. one part (b) other &amp; more\n2. () Whole\nno sense here"
    got = L.senses_of(spark.createDataFrame([("word", raw)], "headword string, raw string")).orderBy("line_no", "part_no").collect()
    assert [(r.sense_id, r.text) for r in got] == [("1", "A thing."), ("1:a", "one part"), ("1:b", "other & more"), ("2", "Whole")]


def test_web(spark):
    words = spark.createDataFrame(list(enumerate(["RUN", "Apple", "run", "Foot", "APPLE"])), "place int, word string")
    assert sorted((r.word_id, r.key, r.shown) for r in L.web(words).collect()) == [(0, "run", "run"), (1, "apple", "Apple"), (3, "foot", "Foot")]


def test_look_up(spark):
    lexicon = spark.createDataFrame([("run", 1), ("carry", 2), ("House", 3)], "word string, concept int")
    user = spark.createDataFrame([("house", -1)], "word string, concept int")
    words = spark.createDataFrame([("running",), ("carried",), ("HOUSE",), ("xyz",)], "word string")
    assert {r.word: r.concept for r in L.looked_up(words, lexicon, user).collect()} == {"running": 1, "carried": 2, "HOUSE": -1, "xyz": None}
    docs = spark.createDataFrame([(1, "They carried a house; running.")], "doc_id long, text string")
    assert [(r.ordinal, r.concept) for r in L.concepts(docs, lexicon, user).orderBy("ordinal").collect()] == [(1, 2), (3, -1), (4, 1)]


def test_prefix_and_parts(spark, senses):
    assert [r.headword for r in L.prefixed(senses, "A", "noun").collect()] == ["apple"]
    assert L.prefixed(senses, "r", "noun").count() == 0 and L.prefixed(senses, "").count() == 4
    assert {r.headword: r.p for r in senses.select("headword", L.part_of_speech(F.col("text")).alias("p")).collect()} == {"run": "verb", "fast": "verb", "apple": "noun", "speed": "noun"}


def test_senses_in_context(spark):
    said = "he put fresh orange juice in the glass and the car had no juice at all".split()
    o = spark.createDataFrame([(1, "juice", said, 4), (2, "juice", said, 13), (3, "glass", said, 7), (4, "juice", ["juice"], 0)], "id int, word string, words array<string>, at int")
    shape = "word string, sense_id string, context array<string>, weight double"
    mined = spark.createDataFrame([("juice", "1.a", ["orange", "fresh"], 1.0), ("juice", "2", ["glass"], 0.5)], shape)
    rules = spark.createDataFrame([("juice", "1.a", ["orange"], 0.9), ("juice", "3", ["car"], 0.8)], shape)
    got = {r.id: (r.sense_id, r.confidence) for r in L.disambiguated(o, mined, rules).collect()}
    assert got == {1: ("1.a", 0.8), 2: ("3", 0.8), 3: ("unknown", 0.0), 4: ("1.a", 0.5)}


def test_drill_down_and_usage(spark, senses):
    got = {(r.reached, r.level) for r in L.drilled(senses, spark.createDataFrame([("run",)], "word string"), 2).collect()}
    assert ("fast", 1) in got and ("speed", 2) in got and ("run", 1) not in got
    picks = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "a", 1)], "doc_id long, ordinal int, sense_id string, at int")
    assert {r.sense_id: r.n for r in L.usage(picks).collect()} == {"b": 1, "a": 1}


@pytest.mark.parametrize("parts,want", [("noun verb noun", ("w0", "w1", "w2")), ("pronoun noun verb preposition noun", ("w1", "w2", None)), ("verb adjective noun", (None, "w0", "w2")), ("noun noun", None)])
def test_spines(spark, parts, want):
    p = parts.split()
    words = F.array(*[F.lit(f"w{i}") for i in range(len(p))])
    got = spark.range(1).select(L.spine(words, F.array(*map(F.lit, p))).alias("s")).first().s
    assert (tuple(got) if got else None) == want


def test_facts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(one(L.fact(F.lit("fine particulate matter"), F.lit("est"), F.lit("pollutant")))) == ("fine particulate matter", 1, "pollutant", 255)
    assert one(L.fact(F.lit("PM2.5"), F.lit("causa"), F.lit("death"), F.lit(200))).strength == 200
    assert tuple(one(L.read_fact(F.lit("pm25 | causa | death")))) == ("pm25", 40, "death", 255) and one(L.read_fact(F.lit("a | per | b"))) is None
    assert len(L.RELATIONS) == 24 and len(L.READ_RELATIONS) == 12


def test_chains(spark):
    s = spark.createDataFrame([(d, i, f"sentence {i} of {d}".split()) for d in (1, 2) for i in range(5)], "doc_id long, ordinal int, words array<string>")
    ids = L.sentence_ids(s, 1_700_000_000_000)
    assert {(r.doc_id, r.n, r.valid, r.broken) for r in L.first_broken(ids).collect()} == {(1, 5, True, None), (2, 5, True, None)}
    bad = ids.withColumn("words", F.when((F.col("doc_id") == 2) & (F.col("ordinal") == 3), F.array(F.lit("x"))).otherwise(F.col("words")))
    assert {r.doc_id: r.broken for r in L.first_broken(bad).collect()} == {1: None, 2: 3}


def test_notes(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    h = spark.range(1).select(L.note_hash(F.split(F.lit("one two three four"), " "), F.lit(1), F.lit(2)).alias("h")).first().h
    notes = spark.createDataFrame([(1, 1, 2, h), (1, 0, 2, h), (1, 3, 9, h), (7, 1, 2, h)], "doc_id long, start int, size int, hash string")
    assert [r.valid for r in L.valid_notes(notes, docs).orderBy("doc_id", F.desc("valid"), "start").collect()] == [True, False, False, False]


def test_html_sentences(spark):
    said = ["<p>One two.<b>Three</b> four? 3.5 of it</p><div>Abstract Five<br/>six", "w " * 2500, "", None, "<p title='Abstract'>x Abstracts x'Abstract 'Abstract'</p>! y?! <i>z.</i>w.<", "a,b " * 499 + "one two. end", "<<p>q</P >r</heading>s\u0001t"]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").orderBy("i").select(S.html_sentences(F.col("t")).alias("s")).collect()]
    assert got[0] == ["One two.", "Three four?", "3.5 of it", "Abstract", "Five", "six"]
    assert [len(s.split()) for s in got[1]] == [1000, 1000, 500] and got[2] == [] and got[3] is None
    assert got[4] == ["x Abstracts x'Abstract '", "Abstract", "'", "!", "y?!", "z.", "w.", "<"]
    assert [len(re.findall("[a-z]+", x)) for x in got[5]] == [1000, 0, 1] and got[6] == ["q", "r", "s t"]


def test_html_sentences_whole(spark, tmp_path):
    spark.createDataFrame([(1, "w " * 2500 + "end. Next")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = language.QUERIES["html_sentences"](spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [len(r.sentence.split()) for r in got] == [2501, 1]


def test_marks():
    assert S.marks("a, b") == [(0, "a", False), (1, ",", True), (2, " ", True), (3, "b", False)]


def test_addresses():
    assert S.merged_addresses(["See this long sentence about many things here.", "http://www.", "site.", "com/page", "Then came a rather long sentence after it all."]) == ["See this long sentence about many things here.", "http://www.site.com/page", "Then came a rather long sentence after it all."]
    assert S.merged_addresses(["Short one.", "Short two."]) == ["Short one.", "Short two."]


KNOWN = {"the": 50, "quick": 3, "brown": 3, "fox": 2, "jumps": 1, "over": 9, "house": 4, "mouse": 2, "light": 2, "in": 30, "inside": 2, "side": 5, "a": 40, "b": 9, "éclair": 1}


def cheapest(word):
    """The cheapest known parts, trying every way."""
    total = sum(KNOWN.values())
    price = {w: math.log(total / n) + wordsplit.PART_COST for w, n in KNOWN.items() if len(w) > 1 or w in "ai"}
    low, best = word.lower(), [(0.0, [])] + [None] * len(word)
    for e in range(1, len(low) + 1):
        ways = [(best[s][0] + price[low[s:e]], [*best[s][1], word[s:e]]) for s in range(e) if best[s] and low[s:e] in price]
        best[e] = min(ways) if ways else None
    return best[-1] and best[-1][1]


@pytest.mark.parametrize("small", [200_000, 0])
def test_words_are_taken_apart(spark, monkeypatch, small):
    monkeypatch.setattr(wordsplit, "SMALL", small)
    said = ["thequickbrownfox", "QuickBrown", "xyzzyinside", "inside", "theb", "ahouse", "insidehouse", "INSIDEMOUSE", "theéclair", "the1fox", "", "x", "thethethe", "thequickbrownfox"]
    known = spark.createDataFrame([(w.title() if w == "fox" else w, n) for w, n in KNOWN.items()], "word string, n long")
    got = {r.word: r.parts for r in wordsplit.taken_apart(spark.createDataFrame([(w,) for w in said], "word string"), known).collect()}
    want = {w: cheapest(w) for w in said if w.isalpha() and w.lower() not in KNOWN and len(w) > 1}
    assert got == {w: p for w, p in want.items() if p and len(p) > 1}
    assert got["insidehouse"] == ["inside", "house"] and got["INSIDEMOUSE"] == ["INSIDE", "MOUSE"]


def test_words_are_rejoined(spark):
    lines = ["ho use the mo use", "light house in si de", "ju m ps ov er", "in side", "zz yy", "qui ck qui ck"]
    tokens = [(i, j, w) for i, x in enumerate(lines) for j, w in enumerate(x.split())]
    known = spark.createDataFrame([(w, n) for w, n in KNOWN.items()], "word string, n long")
    want = []
    for i, x in enumerate(lines):
        ws, at = x.split(), 0
        while at < len(ws):
            upto = next((e for e in range(at, min(len(ws), at + 9)) if "".join(ws[at : e + 1]) in KNOWN), None) if ws[at] not in KNOWN else None
            if upto is not None:
                want.append((i, at, upto, "".join(ws[at : upto + 1])))
            at = at + 1 if upto is None else upto + 1
    got = sorted(tuple(r) for r in wordsplit.rejoined(spark.createDataFrame(tokens, "line int, at int, word string"), known).collect())
    assert got == want and (2, 0, 2, "jumps") in got and (5, 2, 3, "quick") in got


def test_trigrams_and_kinds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.trigram_similarity(F.lit("word"), F.lit("word"))) == 1.0 and one(T.trigram_similarity(F.lit("word"), F.lit("zzz"))) == 0.0
    assert abs(one(T.trigram_similarity(F.lit("cat"), F.lit("cats"))) - 3 / 6) < 1e-9
    assert [one(T.kind_of(F.lit(n))) for n in ("a.PDF", "b.xls", "c.mov", "d.mp3", "e")] == ["Pdf", "Spreadsheet", "Video", "Audio", "Unknown"]
    assert one(T.soft_breaks_removed(F.lit("a=\r\nb=\nc=d"))) == "abc=d"
