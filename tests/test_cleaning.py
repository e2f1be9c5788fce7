"""Repairs, identifiers and walks against plain Python and fixed cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docatlas.functions import chunks, cleaning, identifiers, text as T
from docatlas.operators import graph


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def decoded(s):
    def char(m):
        c = int(m[1], 16)
        return " " if c in (10, 13) else chr(c) if 32 <= c <= 126 else ""

    return re.sub("=([0-9A-Fa-f]{2})", char, s)


@pytest.mark.parametrize("said", ["", "plain", "a=20b", "=3D20", "==41=", "x=0Ay=09z=ff", "=", "no=t hex=4"])
def test_mime(spark, said):
    assert one(spark, cleaning.mime_decoded(F.lit(said))) == decoded(said)


def test_mime_cleanup(spark):
    assert one(spark, cleaning.mime_cleaned(F.lit("let=ter so=\nft =tudent co=] a = g=3Dh"))) == "letter soft tudent co] a = gh"
    assert one(spark, cleaning.mime_cleaned(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("said,want", [("CooperUnion", "Cooper Union"), ("Mary D.Herter", "Mary D. Herter"), ("Institute,publishing", "Institute, publishing"), ("3.5 at google.com", "3.5 at google.com"), ("People's Institute'In", "People's Institute' In"), ("Norton’spublishing", "Norton’s publishing")])
def test_glue(spark, said, want):
    assert one(spark, cleaning.unglued(F.lit(said))) == want


def test_names_and_terms(spark):
    text = F.lit("From: Ann Lee <a@b.c>\nTo: Bob Ray; Cy Young\nDear Dee Fox, lunch with ann lee and with Ann Lee. Best Regards, Grand Hotel and New York; Eve Sm=th")
    names = one(spark, cleaning.people(text))
    assert names == ["Ann Lee", "Bob Ray", "Cy Young", "Dee Fox"]
    found = one(spark, cleaning.terms(text, F.array(*map(F.lit, names))))
    assert "Grand Hotel" in found and "Eve Smth" in found and not {"Best Regards", "New York", "Ann Lee"} & set(found)
    assert one(spark, cleaning.people(F.lit(""))) == []


@pytest.mark.parametrize("word,end,want", [("don", "t", True), ("cat", "t", False), ("we", "re", True), ("x1", "s", False), ("it", "zz", False)])
def test_contractions(spark, word, end, want):
    assert one(spark, cleaning.is_contraction(F.lit(word), F.lit(end))) is want


def test_identifiers(spark):
    digest = "0123456789ABCDEF0123456789abcdef"
    assert one(spark, identifiers.md5_in(F.lit(f"x {digest} y.pdf"))) == digest.lower()
    assert one(spark, identifiers.md5_in(F.lit("short.abcdef"))) is None
    assert one(spark, identifiers.media_type(F.lit("A.AZW3"))) == "application/vnd.amazon.ebook"
    assert one(spark, identifiers.content_kind(F.lit("bare"))) == "unknown"
    assert one(spark, identifiers.volume_id(F.lit("39015t00227848q"))) == "mdp.39015000227848q"
    assert one(spark, identifiers.page_url("u", F.lit("ark:/1/2"), F.lit(3))) is None
    assert one(spark, identifiers.page_url("u", F.lit("mdp.1 2"), F.lit(3))) == "u?id=mdp.1%202&seq=3"


@pytest.mark.parametrize("given,want", [([], []), (["."], ["."]), (["a", "..", "."], ["a..."]), (["a", ". b", "c"], ["a.", "b", "c"]), (["a", "....", "b"], ["a", "....", "b"]), (["a", " "], ["a", " "])])
def test_dots(given, want):
    assert chunks.with_dots(given) == want


@settings(max_examples=100)
@given(st.lists(st.text(".a ", min_size=1, max_size=5)))
def test_dots_keep_all_signs(sentences):
    assert "".join("".join(chunks.with_dots(sentences)).split()) == "".join("".join(sentences).split())


@pytest.mark.parametrize("said", ["zz y " * 2000, "zz yw " * 2000, "z y z z w z v z u zz", "Zz y zZ zZ w Zz v zZ u zz", "z" + " " * 20, "éé y " * 2000])
def test_dominant_character(spark, said):
    """More than 60 % of one ASCII character, in one case, however long the text."""
    solid = "".join(said.split())
    assert one(spark, T.is_junk(F.lit(said))) is any(solid.count(c) > 0.6 * len(solid) for c in set(solid) if c.isascii())


def test_distances(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "a"), (None, "e"), ("e", None)], "src string, dst string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "c"), ("a", "d"), ("a", "e"), ("e", "a"), (None, "a"), ("a", None), ("z", "z"), ("a", "c")], "source string, target string")
    got = sorted(map(tuple, graph.distances(pairs, edges).collect()), key=repr)
    assert got == sorted([("a", "a", 0), ("a", "c", 2), ("a", "c", 2), ("a", "d", 3), ("a", "e", -1), ("e", "a", -1), (None, "a", -1), ("a", None, -1), ("z", "z", 0)], key=repr)
    assert graph.distances(pairs, edges.limit(0)).count() == 9
