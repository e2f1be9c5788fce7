import zipfile

import pytest
from pyspark.sql import functions as F

from docatlas.functions import chunks
from docatlas.operators import ranges, store as S
from docatlas.plans import search
from docatlas.sources import dumps as D


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=repr)


def test_dimension(spark):
    old = spark.createDataFrame([(7, "a", "x"), (8, "b", None)], "id long, name string, note string")
    got = S.dimension(old, spark.createDataFrame([("b", "y"), ("c", None), ("a", None)], "name string, note string"), "name", ["note"])
    assert rows(got, "name", "note") == [("a", "x"), ("b", "y"), ("c", None)]
    assert {r.name: r.id for r in got.collect()}["b"] == 8


def test_documents_and_parts(spark):
    old = spark.createDataFrame([("p", 1, "t", 5)], "path string, at int, title string, pages int")
    got = S.documents(old, spark.createDataFrame([("p", 2, None, 6), ("p", 1, "z", 9), ("q", 1, "n", None)], old.schema))
    assert rows(got) == [("p", 2, "t", 6), ("q", 1, "n", None)]
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, ordinal int, sentence string")
    new = S.sentences_of(spark.createDataFrame([(1, [" x ", " ", "y"])], "doc_id int, s array<string>"), F.col("s"))
    assert rows(S.replaced(parts, new, "doc_id")) == [(1, 0, "x"), (1, 1, "y"), (2, 0, "c")]


def test_patches(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, n int")
    assert rows(S.patched(old, spark.createDataFrame([(1, None, 6), (9, "z", 1)], old.schema), "k")) == [(1, "a", 6), (2, "b", None)]
    vec = spark.createDataFrame([(1, [1.0]), (2, None)], "k int, embedding array<double>")
    assert rows(S.backfilled(vec, spark.createDataFrame([(1, [9.0]), (2, [2.0])], vec.schema), "k")) == [(1, [1.0]), (2, [2.0])]
    assert [S.write_mode(*x) for x in ((5, 0, True), (50, 100, True), (5, 100, True), (5, 100, False))] == ["append", "ignore", "merge", "append"]


def test_lists(spark):
    saved = spark.createDataFrame([("l1", 2, "b", 'say "x"'), ("l1", 1, "a", None), ("l2", 1, "c", "z")], "list_id string, pos int, type string, name string")
    assert [r.line for r in S.exported(saved, "l1").collect()] == ['"a",""', '"b","say ""x"""']
    assert [r.type for r in S.saved_list(saved, "list:l1").collect()] == ["a", "b"] and [r.type for r in S.saved_list(saved, "list:l1", ["b"]).collect()] == ["b"]
    assert S.saved_list(saved, "words") is None


def test_coordination(spark):
    now = 10_000
    known = spark.createDataFrame([("live", "AllFast", now - 10, 1), ("old", "AllDone", now - 5000, 3), ("idle", "AllDone", now - 5000, 1)], "hash string, status string, created long, uses long")
    asked = spark.createDataFrame([("live",), ("live",), ("old",), ("new",)], "hash string")
    got = S.coordinated(known, asked, now)
    assert rows(got) == [("idle", "AllDone", now - 5000, 1), ("live", "AllFast", now - 10, 3), ("new", "Pending", now, 1), ("old", "Pending", now, 1)]
    assert rows(S.expired(got, now), "hash") == [("idle",)]
    done = spark.createDataFrame([("new", 1), ("new", 2), ("old", 1), ("old", 2), ("old", 3), ("old", 4), ("live", 4)], "hash string, tier int")
    assert rows(S.advanced(got, done), "hash", "status") == [("idle", "AllDone"), ("live", "AllFast"), ("new", "AllFast"), ("old", "AllDone")]
    v = lambda *x: spark.createDataFrame(x, "doc_id int, rank int")
    assert [r.doc_id for r in S.refined([v((1, 1), (2, 2), (5, 3)), v((2, 1), (3, 2))]).collect()] == [2, 3, 1, 5]


def test_progress(spark):
    files = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "path string, modified int")
    assert rows(S.unprocessed(files, spark.createDataFrame([("a", 5), ("c", 5)], files.schema)), "path") == [("b",), ("c",)]
    p = spark.createDataFrame([("t", 10, 100)], "table string, last_id long, rows long")
    assert rows(S.progressed(p, "t", 20, 50)) == [("t", 20, 150)]
    assert [r.id for r in D.after_key(spark.range(100), "id", 41, 3).collect()] == [42, 43, 44]


def test_metadata_files(spark):
    docs = search.documents(spark, "/root/testdata/sf0.001")
    got = {r.file: r.body for r in S.metadata_files(docs).collect()}
    assert len(got) == docs.count() and all(f.endswith(("_UnknownDate.json",)) or f[-15:-5].count("-") == 2 for f in got)


def test_priority_of_sentences(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    one = lambda *c: spark.range(1).select(S.raw_or_shown(*c).alias("x")).first().x
    assert [one(a("r"), a("l"), a("s")), one(a(), a("l"), a("s")), one(F.lit(None).cast("array<string>"), a(), a("s")), one(a(), a(), a())] == [["r"], ["l"], ["s"], []]


def test_separators(spark):
    one = lambda s: spark.range(1).select(D.separators(F.lit(s)).alias("x")).first().x
    assert one('"a","b",3,"c"') == 4 and one('"a",b') == -1


def test_sheets(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a, b,,c\n\n , d\n")
    lines = D.sheet_lines(spark, str(tmp_path / "s.csv"))
    assert rows(lines, "row", "line") == [(1, "a | b | c"), (3, "d")]
    one = lines.select("path", F.lit("S1").alias("sheet"), "row", "line")
    assert rows(D.row_lines(one), "line") == [("[R1] a | b | c",), ("[R3] d",)]
    assert rows(D.row_lines(one.union(one.withColumn("sheet", F.lit("S2")))), "line")[0] == ("[S1:R1] a | b | c",)


def test_names_and_schemas(spark):
    paths = spark.createDataFrame([("/x/db.files.00002.dat.gz",), ("/x/db.files.00001.dat.gz",), ("/x/db.one.dat.gz",), ("/x/readme",)], "path string")
    assert rows(D.parts(paths), "table", "part") == [("files", 1), ("files", 2), ("one", 0)]
    ddl = "CREATE TABLE `t` (`id` int, name varchar(10) DEFAULT 'a,(b', price decimal(10,2), PRIMARY KEY (`id`, name))"
    assert D.columns_of(ddl) == ["id", "name", "price"] and D.columns_of("a, `b`") == ["a", "b"]
    got = D.file_list(spark.createDataFrame([("hathi_full_20240301.txt.gz",), ("hathi_upd_20240302.txt.gz",), ("notes",)], "name string"))
    assert [(r.kind, str(r.day)) for r in got.orderBy("day").collect()] == [("full", "2024-03-01"), ("update", "2024-03-02")]
    order = D.folders(spark.createDataFrame([(f"/r/{n}/f",) for n in ("set10", "set2", "Zed")], "path string"), ["zed"])
    assert [r.folder for r in order.collect()] == ["Zed", "set2", "set10"]


def test_files_without_results(spark, tmp_path):
    for p in ("a/x.pdf", "a/Published/y.pdf", "b/z.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    assert rows(D.files(spark, str(tmp_path), ["pdf"]), "name") == [("x.pdf",)]


def test_archives_and_indexes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        for n, t in (("00000002.txt", "two"), ("00000001.txt", "one"), ("cover.txt", "c"), ("x.jpg", "-")):
            z.writestr(n, t)
    assert rows(D.zip_pages(spark, str(tmp_path / "v.zip")), "page", "text") == [(1, "one"), (2, "two"), (3, "c")]
    (tmp_path / "i.csv").write_text(f"a1,p1,{'A' * 32},10,20\na2,p2,nope,1,2\na3,p3,,x,2\n")
    found, lost = D.offset_index(spark, str(tmp_path / "i.csv"))
    assert rows(found, "aacid", "md5", "offset") == [("a1", "a" * 32, 10), ("a2", None, 1)] and rows(lost, "aacid", "offset") == [("a3", "x")]
    (tmp_path / "t.tsv").write_text('k1\t\t{"n": 5}\nshort\nk2\tv\t{bad\n')
    got, short = D.tsv_with_json(spark, str(tmp_path / "t.tsv"), ["k", "v"], "n int")
    assert rows(short) == [("short",)]
    assert [(r.k, r.v, r.data and r.data.n) for r in got.orderBy("k").collect()] == [("k1", None, 5), ("k2", "v", None)]
    listing = spark.createDataFrame([("d", f"{i:04d}", 10) for i in range(1001)] + [("e", "1", 7)], "folder string, path string, length long")
    assert rows(D.inventory(listing)) == [("d", 1001, 10010, True), ("e", 1, 7, False)]
    words = D.dictionary_words(spark.createDataFrame([("Run", "1. () Move FAST on it")], "headword string, raw string"))
    assert rows(words) == [("move",), ("run",)]


def test_ranges(spark):
    import random

    rng = random.Random(1)
    box = lambda n: [(i, rng.randrange(3), a := rng.uniform(-20, 20), a + rng.uniform(-1, 9)) for i in range(n)]
    left, right = box(60), box(50)
    a, b = (spark.createDataFrame(x, "i int, page int, lo double, hi double") for x in (left, right))
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    span = (F.col("lo"), F.col("hi"))
    assert sorted(rows(ranges.overlapping(a, b, ["page"], span, span, 3.0).select("l.i", F.col("r.i").alias("j")))) == want
    free = sorted((x[0],) for x in left if not any(x[1] == y[1] and y[2] <= x[2] <= y[3] for y in right))
    assert rows(ranges.outside(a, b, ["page"], F.col("lo"), span, 3.0), "i") == sorted(free, key=repr)


@pytest.mark.parametrize("said", [["a" * 8, "b" * 3, "c" * 12, "", "d"], [], ["x" * 50, "y"]])
def test_chunks_in_the_jvm_equal_the_fold(spark, said):
    df = spark.createDataFrame([(said,)], "s array<string>")
    assert df.select(chunks.bounded_column(F.col("s"), 12).alias("c")).first().c == chunks.bounded(said, 12)


def test_schemas_lists_and_grids(spark, tmp_path):
    df = spark.createDataFrame([(1, "2", "x")], "a int, b string, c string")
    assert rows(S.conformed(df, "b int, d string")) == [(2, None)]
    lists = spark.createDataFrame([("l1", 1, "a"), ("l2", 1, "b")], "list_id string, pos int, name string")
    S.written_lists(lists, str(tmp_path / "l"))
    S.written_lists(lists.where("list_id = 'l2'").withColumn("name", F.lit("z")), str(tmp_path / "l"))
    assert rows(spark.read.parquet(str(tmp_path / "l")), "list_id", "name") == [("l1", "a"), ("l2", "z")]
    up = spark.createDataFrame([("o", "h1", "f")], "owner string, digest string, file string")
    assert S.registered(up, spark.createDataFrame([("o", "h1", "g"), ("p", "h1", "g")], up.schema)).count() == 2
    nodes = spark.createDataFrame([("Pdf", 2), ("Text", 1), ("Pdf", 3)], "type string, n int")
    assert S.faceted(nodes, ["Text"]).count() == 1 and S.faceted(nodes, []).count() == 3
    assert [r.n for r in S.grid(nodes, {"type": "pd"}, [("n", True)]).collect()] == [3, 2]


def test_permutations(spark):
    for seed in (0, 1, 123456789, 2**63):
        p = chunks.permutation(50, seed)
        assert sorted(p) == list(range(50)) and [p[i] for i in chunks.inverse(p)] == list(range(50))
    assert chunks.permutation(50, 1) != chunks.permutation(50, 2) and chunks.permutation(1, 5) == [0]
    df = spark.createDataFrame([(list("abcdef"), 42)], "x array<string>, s long").withColumn("y", chunks.shuffled_udf(F.col("x"), F.col("s")))
    got = df.withColumn("z", chunks.shuffled_udf(F.col("y"), F.col("s"), True)).first()
    assert got.z == got.x and sorted(got.y) == got.x
    from docatlas.functions import text as T

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    fold = lambda t: ((t >> 32 ^ t & 0xFFFFFFFF) >> 16 ^ (t >> 32 ^ t) & 0xFFFF) & 0x3FFF
    assert one(T.token_hash(F.lit(0x123456789ABCDEF))) == fold(0x123456789ABCDEF)
    assert one(T.lemma_forms(F.lit("Went")))[:3] == ["Went", "go", "went"] and one(T.lemma_forms(F.lit("boxes")))[:4] == ["boxes", "boxe", "box"] + one(T.lemma_forms(F.lit("boxes")))[3:4]


def test_word_streams(spark):
    from docatlas.functions import dsl

    one = lambda **k: [w.text for w in spark.range(1).select(dsl.word_stream(dsl.parsed(F.split(F.lit("hello.u <b> , world.e x"), " ")), **k).alias("x")).first().x]
    assert one(kind="content") == ["hello", "world", "x"] and one(kind="tags") == ["<b>"] and one(start=3, size=99) == ["world", "x"] and one(flags=1) == ["hello"]


def test_book_scan(spark):
    from docatlas.plans import analysis

    html = "<div class='chapter' id='ch2'><span id=\"page7\">The old Paris. It is 12 of</span><span id=\"pageix\">them"
    got = analysis.scanned(spark.createDataFrame([(1, html)], "k int, html string"), "k").orderBy("ordinal").collect()
    words = [(r.token, r.kind, r.sentence, r.page, r.chapter) for r in got if r.kind not in ("tag", "space", "punctuation")]
    assert words == [("The", "stop", 0, 7, 2), ("old", "content", 0, 7, 2), ("Paris", "proper", 0, 7, 2), ("It", "stop", 1, 7, 2), ("is", "stop", 1, 7, 2), ("12", "number", 1, 7, 2), ("of", "stop", 1, 7, 2), ("them", "content", 1, -9, 2)]
