import json

from docatlas.sources import catalogs
from docatlas.streaming import events as E


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:10:00", i % 3, "view", float(i)) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double")
    e = e.selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = E.windowed(E.stream(spark, str(tmp_path / "in")), late="1 day").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, E.windowed(e).collect()))


def test_first_within_drops_copies(spark, tmp_path):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "user_id long, event_type string").selectExpr("*", "timestamp '2024-01-01 00:00:00' AS ts")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = E.first_within(E.stream(spark, str(tmp_path / "in")), ["user_id"]).writeStream.format("memory").queryName("first").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(r.user_id for r in spark.table("first").collect()) == [1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("h1\tALLOW\t \nshort\n")
    assert [tuple(r) for r in catalogs.tsv(spark, str(tmp_path / "b.tsv"), ["id", "access", "note"]).collect()] == [("h1", "allow", None)]
    rows = [{"aacid": "q", "metadata": {"record": {"titleInfo": {"text": "T"}, "machineReadableDate": "19xx"}}}, {"metadata": {}}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    assert [(r.aacid, r.title, r.date_year) for r in catalogs.json_lines(spark, str(tmp_path / "c.json")).collect()] == [("q", "T", None)]
