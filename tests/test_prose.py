import pytest
from pyspark.sql import functions as F

from docatlas.functions import dsl, prose as P, text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    "said,query,want",
    [
        ("Red & <b>", "red", '<mark class="whole">Red</mark> &amp; &lt;b&gt;'),
        ("redder red", "red", '<mark class="part">red</mark>der <mark class="whole">red</mark>'),
        ("a lamp & amp", "amp a", 'a l<mark class="part">amp</mark> &amp; <mark class="whole">amp</mark>'),
        ("nothing", "x", "nothing"),
    ],
)
def test_highlights(spark, said, query, want):
    assert one(spark, P.highlighted(lit(said), query)) == want


def test_terms_longest_first():
    assert P.search_terms("Cat a catalogue CAT") == ["catalogue", "Cat"]


@pytest.mark.parametrize("said,want", [("[1] one [2] two", "[1] one<br/>[2] two"), ("x <y> [10] z", "x &lt;y&gt;<br/>[10] z")])
def test_breaks(spark, said, want):
    assert one(spark, P.sentence_breaks(lit(said))) == want


def test_numbering_and_model(spark):
    assert one(spark, P.numbered(F.array(lit("a."), lit(" "), lit("b.")))) == "\n[1] a.\n[2] b."
    assert len(one(spark, P.for_model(lit("x" * 3000)))) == 2000 and len(one(spark, P.for_model(lit("x" * 3000), 1))) == 1500


def test_abstracts(spark):
    body = "we show that hyphen-\nated words are put together and more is said here"
    assert one(spark, P.abstract(lit(f"Title\nAbstract: {body} Introduction the rest"))) == "we show that hyphenated words are put together and more is said here"
    assert one(spark, P.abstract(lit("no heading in this text"))) == "no heading in this text"


@pytest.mark.parametrize("said,want", [("xiv", 14), ("MCMXCIX", 1999), ("iiii", None), ("", None), ("iv", 4)])
def test_roman(spark, said, want):
    assert one(spark, P.roman(lit(said))) == want


def test_markers(spark):
    assert [one(spark, P.page_marker(lit(x))) for x in ('<span id="page12">', '<a id="pagexii"/>', "<p>")] == [12, -12, None]
    assert [one(spark, P.chapter_marker(lit(x))) for x in ("<div class='chapter' id='ch07'>", "<div class='chapter' id='part3'>", "<div id='ch1'>")] == [7, 3, None]
    assert [tuple(x) for x in one(spark, P.image_markers(lit("[image.sz(10x20,p3)] a [image.sz(1x1,p3)] [image.sz(5x5,p4)]")))] == [(3, "10x20"), (4, "5x5")]


def test_figures(spark):
    assert [one(spark, P.readable_size(F.lit(n).cast("long"))) for n in (512, 1536, 5 << 20, 3 << 30)] == ["0.5 KB", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert [one(spark, P.readable_duration(F.lit(n))) for n in (59.9, 61, 3661)] == ["0:59", "1:01", "1:01:01"]
    assert one(spark, P.frame_rate(lit("30000/1001"))) == 29.97 and one(spark, P.frame_rate(lit("5/0"))) is None
    assert one(spark, P.download_url(lit("http://h/"), lit("set 1"), lit("a b.pdf"))) == "http://h/set%201/a%20b.pdf" and one(spark, P.download_url(lit("h"), lit(None), lit("f"))) is None


def test_repairs(spark):
    assert one(spark, P.artifacts_removed(lit("see ( here) http://a.example/ path/ to/ x Now"))) == "see (here) http://a.example/path/to/x Now"
    assert one(spark, P.around_identifiers(lit("before EFTA00012345 after"))) == ["before", "EFTA00012345", "after"]
    known = F.array(lit("house"), lit("mouse"))
    assert one(spark, P.stray_equals_resolved(lit("the ho=se a=b =word end= x==y"), known)) == "the house a b word end x==y"
    assert [one(spark, P.is_abbreviation(lit(w))) for w in ("Dr.", "vol", "house")] == [True, True, False]


WORDS = [("hello.u", "Hello"), ("list.c", "list,"), ("end.e", "end."), ("say.qo", '"say'), ("done.eqc", 'done."'), ("x.U", "X"), ("re.ns", "re"), ("google.com", "google.com"), ("<b>", "<b>")]


@pytest.mark.parametrize("token,want", WORDS)
def test_codes(spark, token, want):
    word = F.get(dsl.parsed(F.array(lit(token))), F.lit(0))
    assert one(spark, dsl.shown(word)) == want
    assert one(spark, dsl.compiled(word)) == token


def test_rendering(spark):
    tokens = F.split(lit("hello.u world.c <b> it .ns s.ns fine.e"), " ")
    assert one(spark, dsl.rendered(dsl.parsed(F.split(lit("hello.u world.c it 's.ns fine.e"), " ")))) == "Hello world, it's fine."
    assert one(spark, dsl.for_embedding(dsl.parsed(tokens))).startswith("Hello world,") and "<b>" not in one(spark, dsl.for_embedding(dsl.parsed(tokens)))


def test_token_kinds(spark):
    kinds = lambda f: [one(spark, f(lit(t))) for t in ("word", "<p>", ",", "7", "x", " ", "two words")]
    assert kinds(dsl.is_content) == [True, False, False, False, True, False, True]
    assert kinds(dsl.is_punctuation) == [False, False, True, False, False, False, False]
    assert kinds(dsl.is_numeric)[3] and kinds(dsl.is_tag)[1] and kinds(dsl.is_single_word)[-1] is False
    assert one(spark, dsl.interspersed(F.array(lit("a"), lit("b")))) == ["a", " ", "b"]
    assert [one(spark, dsl.appended(lit(a), lit(b))) for a, b in (("a", "b"), ("a", ", b"), ("", "b"))] == ["a b", "a, b", "b"]
    assert one(spark, dsl.content_length(lit("word.Name()"))) == 4


def test_windows_of_tokens(spark):
    sentences = F.array(*[F.array(*map(lit, s.split("|"))) for s in ("a1| |b1|.", "c1|d1|!", "e1|,|f1")])
    assert one(spark, dsl.windows(sentences, 4)) == [["a1", "b1.e", "c1", "d1.x"], ["c1", "d1.x", "e1.c", "f1"]]
    assert one(spark, dsl.windows(sentences, 2)) == [["a1", "b1.e"], ["a1", "b1.e", "c1", "d1.x"], ["c1", "d1.x", "e1.c", "f1"]]


@pytest.mark.parametrize("said,want", [("7 . 4 . 1999", "1999-07-04"), ("7 . 4 . 99", "1999-07-04"), ("25--12--2003", "2003-12-25")])
def test_scrappy_dates(spark, said, want):
    assert str(one(spark, T.deduced_date(lit(said)))) == want


@pytest.mark.parametrize("said,want", [("straße", "STRAẞE"), ("ßa", "ẞA"), ("ŉΐﬁx", "ŉΐﬁX"), ("ᾳé", "ᾼÉ"), ("", ""), (None, None)])
def test_capitals_are_one_letter_each(spark, said, want):
    assert one(spark, T.capitals(lit(said))) == want


def test_codes_of_case_keep_a_sharp_s_one_letter(spark):
    words = F.array(lit("ßch.u"), lit("groß.U"))
    assert one(spark, dsl.marked_up(dsl.parsed(words))) == one(spark, dsl.rendered(dsl.parsed(words))) == "ẞch GROẞ"
