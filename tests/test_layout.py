from pyspark.sql import functions as F

from docatlas.functions import layout as L, prose as P
from docatlas.plans import analysis
from docatlas.streaming import documents as S, events as E

SHAPE = "page int, no int, text string, x double, y double, width double, font double"


def test_runs(spark):
    rows = [(0, 0, "Hel", 0, 0, 15, 10), (0, 1, "lo", 16, 0, 10, 10), (0, 2, "far", 60, 0, 15, 10), (0, 3, "down", 0, 9, 20, 10), (0, 4, "big", 21, 9, 20, 14), (1, 0, "new", 0, 9, 9, 14)]
    got = L.runs(spark.createDataFrame([tuple(map(float, r[3:])) and (*r[:3], *map(float, r[3:])) for r in rows], SHAPE))
    assert [r.text for r in got.orderBy("page", "run").collect()] == ["Hello", "far", "down", "big", "new"]


def test_redactions(spark):
    rows = [(0, 0, "from", 0.0, 0.0, 20.0, 10.0), (0, 1, "now", 70.0, 0.0, 15.0, 10.0), (0, 2, "on", 86.0, 0.0, 10.0, 10.0), (0, 3, "x", 116.0, 0.0, 5.0, 10.0)]
    df = spark.createDataFrame(rows, SHAPE)
    assert [(r.no, r.marker) for r in L.redactions(df).collect()] == [(1, "[redact.char(10)]")]
    assert [(r.no, r.marker) for r in L.redactions(df, True).orderBy("no").collect()] == [(1, "[redact.email.char(10)]"), (3, "[redact.email.char(4)]")]
    assert L.page_count(df).first().pages == 1


def test_sentences_from_places(spark):
    words = ["Mr.", "A.", "Smith", "paid", "3.", "5", "times.", "Why?", "No", "one", "knows."]
    rows = [(0, i, w, 30.0 * i, 0.0, 25.0, 10.0) for i, w in enumerate(words)] + [(1, 0, "End", 0.0, 0.0, 25.0, 10.0)]
    df = spark.createDataFrame(rows, SHAPE)
    assert [r.text for r in L.sentences(df).orderBy("page", "sentence").collect()] == ["Mr. A. Smith paid 3. 5 times.", "Why?", "No one knows.", "End"]
    hidden = spark.createDataFrame([(0, 7)], "page int, no int")
    assert "Why?" not in [r.text for r in L.sentences(df, hidden).collect()]


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(P.local_path(F.lit("D:\\Data\\set\\a.pdf"), "d:\\data", "/srv")) == "/srv/set/a.pdf" and one(P.local_path(F.lit("/x//y"), "d:\\data", "/srv")) == "/x/y"
    assert one(P.expanded(F.lit("Adv."), {"adv": "adverb"})) == "adverb" and one(P.expanded(F.lit("word"), {"adv": "adverb"})) == "word"
    assert one(P.first_year(F.lit("c1987-88"))) == 1987 and one(P.page_name(F.lit(12))) == "00000012.txt"
    sentences = F.array(F.lit(" "), F.lit('a \u25a0 "b" ( c'), F.lit("x EFTA00012345 y is more"), F.lit("aaaaaaaaaaaaaaaaaaaa"))
    assert one(P.clean_sentences(sentences)) == ["a - 'b' (c", "x", "EFTA00012345", "y is more"]


def test_sentences_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One here. Two there!\nThree?")
    got = []
    for name, text in (("b.txt", None), ("c.txt", "Late one.")):
        if text:
            (tmp_path / "in" / name).write_text(text)
        q = S.handed(S.sentences(spark, str(tmp_path / "in")), str(tmp_path / "ck"), lambda df, n: got.extend(r.sentence for r in df.orderBy("path", "ordinal").collect()))
        q.awaitTermination(60)
    assert got == ["One here.", "Two there!", "Three?", "Late one."]


def test_late_events_are_left_out(spark, tmp_path):
    at = lambda i, t: spark.createDataFrame([(i, t, 1, "view", 1.0)], "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value")
    for i, t in enumerate(("2024-01-01 00:10:00", "2024-01-01 05:00:00", "2024-01-01 00:20:00", "2024-01-01 09:00:00")):
        at(i, t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = E.windowed(E.stream(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = {str(r.start): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 1}  # the event of 00:20 came after its window was closed


def test_kept_events_restart_after_a_time_to_live(spark):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", 1, "view") for i, m in enumerate((0, 20, 29, 30, 45, 59))]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type")
    assert sorted(r.event_id for r in E.kept_within(e, ["user_id", "event_type"]).collect()) == [0, 3]
    assert analysis.QUERIES["dedupe_ttl"]
