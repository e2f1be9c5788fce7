import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docatlas.functions import chunks, text as T
from docatlas.operators import merge
from docatlas.plans import texts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "said,day",
    [("on January 5, 2004 we", "2004-01-05"), ("07 Jul 2011", "2011-07-07"), ("13/07/2011", "2011-07-13"), ("at 2012-03-04.", "2012-03-04"), ("7 . 4 . 99", "1999-07-04"), ("in 1987 it", "1987-01-01"), ("never", None), ("on 3 Jan 2015 and Feb 4, 2016", "2015-01-03"), ("Feb 4, 2016 and 3 Jan 2015", "2015-01-03"), ("3 Jan 2015, March 5 2014", "2014-03-05"), ("31 Feb 2015 or 02/03/2016", "2016-02-03"), ("9/8/45", "1945-09-08"), ("1.2.123", "0123-01-02")],
)
def test_dates(spark, said, day):
    assert one(spark, T.deduced_date(F.lit(said))) == (day and datetime.date.fromisoformat(day))


def test_a_text_is_told_once_for_all_forms_of_dates(spark):
    rows = spark.range(3).select(T.deduced_date(F.concat(F.lit("on "), F.col("id").cast("string"))).alias("day"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("substring(") == 1


@pytest.mark.parametrize("said,junk", [("short", False), ("aaaaaaaaaaaaaaaa", True), ("0x11 0x22 0x33 and more", True), ("A plain sentence about a plain matter, no more.", False), (None, False)])
def test_junk(spark, said, junk):
    assert one(spark, T.is_junk(F.lit(said).cast("string"))) is junk


@pytest.mark.parametrize("token,want", [("hello.u", ("hello", 1, "")), ("list.c", ("list", 0, ",")), ("hello.uqo", ("hello", 33, "")), ("anti.uns", ("anti", 5, "")), ("google.com", ("google.com", 0, "")), ("bob@example.co.uk", ("bob@example.co.uk", 0, ""))])
def test_dsl(spark, token, want):
    assert tuple(one(spark, T.dsl_parsed(F.lit(token)))) == want


def test_checksum_lemmas_and_names(spark):
    assert one(spark, T.positional_checksum(F.array(F.lit("ab"), F.lit("c")))) == 393
    assert "run" in one(spark, T.lemma_forms(F.lit("running"))) and "carry" in one(spark, T.lemma_forms(F.lit("carried")))
    assert one(spark, T.names_all_match(F.array(F.lit("Ann Lee"), F.lit("Bo Ray")), ["ann", "RAY"]))
    assert one(spark, T.natural_key(F.lit("a10b2"))) == "a0000000010b0000000002"
    assert one(spark, T.dsl_stripped(F.array(F.lit("Hello.u"), F.lit("world"), F.lit("!")))) == "Hello world !"


def test_uuid8_round_trip(spark):
    want = (1_700_000_000_000, 77, 513, 200, 4000, 65520, 1000)
    high, low = T.uuid8_halves(*(F.lit(x) for x in want))
    assert tuple(one(spark, T.uuid8_fields(high, low))) == want


@settings(max_examples=100)
@given(st.lists(st.text("ab c", min_size=1, max_size=9)))
def test_chunks_keep_all_words(sentences):
    got = chunks.bounded(sentences, 12)
    assert " ".join(got).split() == " ".join(sentences).split()


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(old, new.dropDuplicates(), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, merge.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, merge.latest(new, ["k"], ["v"]).collect())) == [(2, "c"), (3, "d")]
    tiers = spark.createDataFrame([(1, 7, 1), (2, 7, 3), (2, 7, 9)], "tier int, doc_id long, rank int")
    assert abs(merge.fused(tiers).first().score - (1 / 62 + 1 / 64)) < 1e-12


def test_words_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "Running  hello.uqo\nlist.c"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    forms = {(r.doc_id, r.ordinal): r.forms for r in texts.QUERIES["lemma_lookup"](spark, str(tmp_path)).collect()}
    assert sorted(forms) == [(1, 0), (1, 1), (1, 2)] and "run" in forms[1, 0] and forms[1, 2][0] == "list.c"
    fields = {(r.doc_id, r.ordinal): tuple(r.t) for r in texts.QUERIES["dsl_fields"](spark, str(tmp_path)).collect()}
    assert fields == {(1, 0): ("Running", 0, ""), (1, 1): ("hello", 33, ""), (1, 2): ("list", 0, ",")}


@pytest.mark.parametrize(
    "said,label",
    [("an Image of the memorandum", "Image"), ("MEMORANDUM report", "Memorandum"), ("report email", "Report"), ("e email letter", "Email"), ("letter to court", "Letter"), ("court order", "Court Document"), ("order motion", "Court Order"), ("motion subpoena", "Motion"), ("subpoena case id", "Subpoena"), ("Case ID fbi", "Case File"), ("fbi transcript", "FBI Document"), ("transcript affidavit", "Transcript"), ("affidavit warrant", "Affidavit"), ("a warrant", "Warrant"), ("x" * 2000 + "image", None), (None, None)],
)
def test_title_cascade(spark, said, label):
    assert one(spark, T.title(F.lit(said).cast("string"), F.lit("a.pdf"))) == (f"{label} - a.pdf" if label else "a.pdf")


def test_title_cascade_is_registered(spark, tmp_path):
    spark.createDataFrame([(5, "the FBI wrote"), (8, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.title for r in texts.QUERIES["title_cascade"](spark, str(tmp_path)).collect()} == {5: "FBI Document - DOC00000005.pdf", 8: "DOC00000008.mp4"}


@pytest.mark.parametrize("said,junk", [("\x01\x02~^\x03|<\x04 ab" * 4, True), ("~^|" * 9 + "~^", False), ("~^|<" * 5 + "abcdefghijklmnopqrst" + "1.", False), ("Grüße, 'quoted' [text] (of) letters & signs #1 @2 $3", False)])
def test_junk_of_binary_noise(spark, said, junk):
    assert one(spark, T.is_junk(F.lit(said))) is junk


def test_chunkers_hold_few_rows_in_python(spark):
    for made in (chunks.sliding_udf(F.col("t")), chunks.with_dots_udf(F.split("t", "x"))):
        plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(made)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_a_dominant_character_is_found_however_it_is_spread(spark):
    said = ["ab" * 3 + "aac" * 40, "aab" * 40, "aaabb" * 20, "aaaabb" * 20, "baa" * 33 + "a", "ab" * 60]
    want = []
    for t in said:
        want.append(max(map(t.count, set(t))) > 0.6 * len(t))
    spread = [r.j for r in spark.createDataFrame([(i, t.translate({97: "z", 98: "y", 99: "x"})) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(T.is_junk(F.col("t")).alias("j")).collect()]
    assert spread == want
