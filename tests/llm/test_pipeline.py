"""The pipeline over a small folder, each stage held against what it says it does."""

import re

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from docatlas.llm import common

A = "the cat and the dog of that house are in the garden with some of the birds that sing in the old tree for all to hear"


def test_stages_take_effect(spark, tmp_path):
    texts = [A, A, A + " too", None, "", "1234 !!", "password = hunter2hunter2 " + " ".join(f"word{i} the" for i in range(40)), *(" ".join(f"{w}{i}" for w in A.split()) for i in range(12))]
    ids = list(range(len(texts)))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([1] * len(ids), pa.int32()), "toxic": pa.array([0] * len(ids), pa.int32())}), tmp_path / "labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "t")
        seen.append((name, docs.columns, {r.doc_id: r for r in docs.collect()}))
    assert all(c == columns for _, c, _ in seen[:-1])
    assert set(seen[0][2]) == set(ids) - {3, 4, 5}
    assert set(seen[1][2]) == set(ids) - {1, 2, 3, 4, 5}
    secret = seen[2][2][6]
    assert secret.text.startswith("[SECRET] word0") and secret.n_chars == len(secret.text) and not re.search("hunter2", secret.text)
    assert seen[2][2][0].text == A
    assert set(seen[3][2]) == set(seen[2][2])  # all clean
    assert set(seen[4][2]) == set(seen[3][2])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[4][2])


def tables(folder, docs, labels):
    folder.mkdir()
    pq.write_table(docs, folder / "documents.parquet")
    pq.write_table(labels, folder / "labels.parquet")
    return str(folder)


LABELS = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "quality": pa.array([1, 1], pa.int32()), "toxic": pa.array([0, 0], pa.int32())})


def test_columns_that_clash_stay_as_they_are(spark, tmp_path):
    names = ["score", "lang_pred", "blob", "findings", "row_id", "copies", "tokens", "own", "id", "rate", "domain", "p", "u"]
    texts = [A, "token: abcdefghijklmno " + A.replace("the", "one"), "  ".join(f"{w}{i}" for i, w in enumerate(A.split() * 3000))]
    docs = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": texts, "lang": ["en"] * 3} | {n: [f"{n}{i}" for i in range(3)] for n in names})
    folder = tables(tmp_path / "t", docs, LABELS)
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, folder), "t")
        rows = {r.doc_id: r.asDict() for r in docs.collect()}
        assert sorted(rows) == [1, 2, 3], name
        assert all(rows[i][n] == f"{n}{i - 1}" for i in rows for n in names), name
    assert rows[2]["text"].startswith("[SECRET]") and len(rows[3]["text"]) == len(texts[2])


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    docs = pa.table({"doc_id": pa.array([1, 1, None, 2], pa.int64()), "text": [A, A, A, A + " with quite a few other words after it all in one more line"], "lang": ["en"] * 4, "n_chars": pa.array([1, 1, 1, 1], pa.int32())})
    folder = tables(tmp_path / "t", docs, LABELS)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {1, 2}
    whole = common.table(spark, folder, "documents")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, whole, folder).collect()) == [1, 2]
    again = whole.withColumn("text", corpus_pipeline.F.concat(corpus_pipeline.F.lit("token: abcdefghijklmno "), "text"))
    masked = corpus_pipeline.secret_scan(spark, again, folder).collect()
    assert len(masked) == 4 and all(r.text.startswith("[SECRET] ") for r in masked)  # a row without an id as well
    folder = tables(tmp_path / "e", docs.slice(0, 0), LABELS.slice(0, 0))
    assert corpus_pipeline.run(spark, folder).count() == 0
