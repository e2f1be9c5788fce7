"""Searches as a stream: late tiers, questions that come again, a restart from the checkpoint, expiry by timer."""

import datetime as dt

import pytest

from docatlas.streaming import searches as S


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(minutes=minute, seconds=second)


def run(spark, tmp_path, batches, ttl=600):
    """Each batch is a file, read in a run of its own, so that every run starts again from the checkpoint."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, S.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        stream = spark.readStream.schema(S.INPUT).parquet(str(tmp_path / "in"))
        q = S.tracked(stream, ttl, "1 second").writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append([(r.hash, r.event, r.version, r.status, r.uses, r.docs) for r in sorted(got, key=lambda r: (r.hash, r.at, r.version))])
    return out


def test_fusion():
    assert S.fused({1: [5, 6], 2: [6]}) == [6, 5] and S.fused({}) == [] and S.fused({3: [2, 2, 1], 4: []}) == [2, 1]
    assert S.fused({1: [9], 2: [3]}) == [3, 9]
    assert [S.status(s) for s in ({1}, {1, 2}, {1, 2, 3}, {1, 2, 3, 4}, {3, 4})] == ["Pending", "AllFast", "AllMedium", "AllDone", "Pending"]


def test_a_search_from_question_to_end(spark, tmp_path):
    got = run(
        spark, tmp_path,
        [
            [("a", at(0), None, None), ("a", at(0, 5), None, None), ("b", at(0), None, None), ("a", at(0, 6), 1, [1, 2])],
            [("a", at(1), 3, [2, 3]), ("a", at(1), None, None), ("a", at(2), 1, [9]), ("c", at(2), 1, [4])],
            [("a", at(3), 2, [2]), ("a", at(4), 4, [])],
            [("z", at(30), None, None)],
            [("z", at(31), 2, [7]), ("a", at(32), None, None), ("a", at(32, 1), 2, [8])],
        ],
    )
    assert got[0] == [("a", "started", 0, "Pending", 1, []), ("a", "refined", 1, "Pending", 2, [1, 2]), ("b", "started", 0, "Pending", 1, [])]
    assert got[1] == [("a", "refined", 2, "Pending", 3, [2, 1, 3])]  # a tier that comes again and one without a search change nothing
    assert got[2] == [("a", "refined", 3, "AllMedium", 3, [2, 1, 3]), ("a", "refined", 4, "AllDone", 3, [2, 1, 3])]
    later = got[3] + got[4]
    assert ("a", "expired", 4, "AllDone", 3, []) in later and ("b", "expired", 0, "Pending", 1, []) in later  # by timer: nobody asked for b again
    assert [x for x in later if x[0] == "a" and x[1] != "expired"] == [("a", "started", 0, "Pending", 1, []), ("a", "refined", 1, "Pending", 1, [8])]
    assert sum(x[1] == "expired" for x in later) == 2


@pytest.mark.parametrize("gap,started", [(9, 1), (10, 2), (25, 2)])
def test_a_search_lives_its_time(spark, tmp_path, gap, started):
    got = run(spark, tmp_path, [[("a", at(0), None, None), ("a", at(gap), None, None)]])
    assert sum(x[1] == "started" for x in got[0]) == started
