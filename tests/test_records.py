import zipfile

import pytest
from pyspark.sql import functions as F

from docatlas.functions import identifiers as I, layout as L
from docatlas.operators import schema
from docatlas.plans import analysis, search
from docatlas.sources import dumps as D


def test_identifiers(spark):
    digest = "002d6a691d6ba44177874fbb6ec6d297"
    files = [("md5", f"a/{digest.upper()}.pdf"), ("aacid", "aacid__x__20250101T000000Z__ab.zip"), ("aacid", f"md5_{digest}.pdf"), ("htid", "mdp.390.zip"), ("ia_id", "some-book.pdf"), ("other", "plain.pdf"), ("md5", None)]
    got = spark.createDataFrame(files, "kind string, name string").select(I.identifier(F.col("name"), F.col("kind")).alias("i")).select("i.*").collect()
    assert [tuple(r) for r in got] == [(digest, "md5", digest), ("aacid__x__20250101T000000Z__ab", "aacid", None), (digest, "md5", digest), ("mdp.390", "htid", None), ("some-book", "ia_id", None), (None, "md5", None), (None, "md5", None)]


def test_reading_order(spark):
    rows = [(1, 0, "right", 50.0, 10.0, 20.0, 10.0), (1, 1, "left", 0.0, 11.5, 20.0, 10.0), (1, 2, "close", 71.0, 10.0, 20.0, 10.0), (1, 3, "below", 0.0, 30.0, 20.0, 10.0), (2, 0, "next", 0.0, 0.0, 9.0, 10.0)]
    made = L.read_order(spark.createDataFrame(rows, "page int, no int, text string, x double, y double, width double, height double"))
    assert [(r.text, r.line, r.blank) for r in made.orderBy("page", "place").collect()] == [("left", True, False), ("right", False, True), ("close", False, False), ("below", True, False), ("next", True, False)]
    assert sorted(map(tuple, L.page_texts(made).collect())) == [(1, "left rightclosebelow"), (2, "next")]


def test_a_place_taken_twice_keeps_the_first_row_of_the_table(spark, tmp_path):
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long, l_partkey long"
    path = tmp_path / "lineitem.parquet"
    path.mkdir()
    more = [(100 + i, 1, float(i % 50), i, i) for i in range(5000)]  # Spark reads larger files first
    for no, rows in enumerate([[(1, 1, 1.0, 1, 1), (1, 1, 2.0, 2, 2)], [(1, 1, 3.0, 3, 3), (1, 2, 4.0, 4, 4), *more], [(1, 2, 5.0, 5, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{no}")
        next((tmp_path / str(no)).glob("part-*.parquet")).rename(path / f"part-{no}.parquet")
    got = analysis.glyphs(spark, str(tmp_path)).where("page = 1").orderBy("no").select("no", "x", "y", "font", "width").collect()
    assert [tuple(r) for r in got] == [(1, 3.0, 1.0, 9.0, 2.0), (2, 12.0, 4.0, 12.0, 5.0)]


def test_richer(spark):
    rows = [("a b", "a b c"), ("a\r\nb", "long-word here"), (None, "x"), ("x", None), ("x", " ")]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(L.richer(F.col("a"), F.col("b"))).collect()] == ["a b c", "a\r\nb", "x", "x", "x"]


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t> shared </t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3"><v>1.5</v></c><c r="C3"/></row><row r="4"/><row r="5"><c t="s"><v>1</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>in line</t></is></c></row></sheetData></worksheet>')
    got = D.workbook_lines(spark, str(tmp_path / "b.xlsx"))
    assert sorted((r.sheet, r.row, r.line) for r in got.collect()) == [("One", 1, "shared | 1.5"), ("One", 3, "rich | TRUE"), ("Two", 1, "in line")]
    assert sorted(r.line for r in D.row_lines(got).collect()) == ["[One:R1] shared | 1.5", "[One:R3] rich | TRUE", "[Two:R1] in line"]


def test_tables_of_a_store(spark):
    name = "records_store_docs"
    try:
        assert schema.migrated(spark, {name: "id long, title string"}) == {name: ["id", "title"]}
        spark.createDataFrame([(1, "a")], "id long, title string").write.insertInto(name)
        assert schema.migrated(spark, {name: "id long, title string, day date"}) == {name: ["day"]}
        assert [tuple(r) for r in spark.table(name).collect()] == [(1, "a", None)]
        assert schema.migrated(spark, {name: "id long, title string, day date"}) == {name: []}
        with pytest.raises(ValueError, match="title"):
            schema.migrated(spark, {name: "id long, title int"})
        schema.emptied(spark, [name])
        assert spark.table(name).count() == 0
    finally:
        schema.dropped(spark, [name])
    assert not spark.catalog.tableExists(name)


def test_grammar(spark):
    docs = spark.createDataFrame([(1, "in 1999 of a@b.org"), (2, "\U0001f600 on 2001-02-03"), (3, "nothing"), (4, None), (5, "2001-02-03")], "doc_id long, text string")
    got = [(r.doc_id, r["rank"], r.kind, r.position, r.snippet) for r in search.grammar_tier(docs).orderBy("rank").collect()]
    assert got == [(1, 1, "mail", 12, "a@b.org"), (5, 2, "day", 1, "2001-02-03"), (2, 3, "day", 6, "2001-02-03")]


def test_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.source, r["rank"], r.target) for r in search.relationships([1, 4], vectors, 2).collect())
    assert got == [(1, 1, 6), (1, 2, 2)]
    with pytest.raises(ValueError, match="at most"):
        search.relationships(list(range(201)), vectors)


def test_a_merged_search_fuses_all_five_tiers(spark, tmp_path):
    docs = [(1, "mail ab@cd.de", "de", "src1", 13), (2, "short", "en", "src1", 5), (3, "of the", "de", "src1", 6), (7, "plain", "de", "src1", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = search.QUERIES["search_merged"](spark, str(tmp_path)).orderBy("final_rank").collect()
    told = [(r.doc_id, next(i for i in range(1, 6) if r[f"t{i}_rank"]), r.score, r.snippet) for r in rows]
    first, second = round(1 / 62, 9), round(1 / 63, 9)
    assert told == [(0, 4, first, "distance 0.000000"), (1, 5, first, "ab@cd.de"), (2, 2, first, None), (3, 3, first, "of the"), (7, 1, first, None), (4, 4, second, "distance 1.000000")]
    assert all(sum(r[f"t{i}_rank"] is not None for i in range(1, 6)) == 1 for r in rows)
