"""Every query that has plain SQL gives what DuckDB gives."""

import duckdb
import pytest

from docatlas.plans import analysis, catalogue, language, records, search, texts, vectors

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries() | texts.QUERIES | search.QUERIES | analysis.QUERIES | language.QUERIES | records.QUERIES | vectors.QUERIES, catalogue.oracle_sql() | texts.ORACLES | search.ORACLES | analysis.ORACLES | language.ORACLES | records.ORACLES | vectors.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_plain_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


#: What the queries without SQL must give at least: a row for each row of what they read, or some rows.
ROWS = {n: "documents" for n in ("title_cascade", "junk_flags", "mime_cleanup", "glue_removed", "abstracts")} | {"names_and_terms": "conversations", "clean_sentences": "conversations", "highlights": "benchmark"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_whole_rows(spark, con, name):
    rows = QUERIES[name](spark, DIR).collect()
    if name in ROWS:
        assert len(rows) == con.execute(f"SELECT count(*) FROM {ROWS[name]}").fetchone()[0]
    assert rows and any(v not in (None, "", []) for v in rows[0])
    assert len({str(r) for r in rows}) > 1


def test_set_operators_take_whole_tables(spark, con):
    got = {n: [r[0] for r in QUERIES[n](spark, DIR).collect()] for n in ("list_merge", "list_xor", "list_trim", "list_append", "intersect_lists")}
    docs, labels, vecs = ([r[0] for r in con.execute(f"SELECT {c} FROM {t}").fetchall()] for c, t in (("doc_id", "documents"), ("doc_id", "labels"), ("vec_id", "embeddings")))
    assert sorted(got["list_merge"]) == sorted(set(docs) | set(labels)) and sorted(got["list_xor"]) == sorted(set(docs) ^ set(vecs))
    assert sorted(got["list_trim"]) == sorted(2 * [d for d in docs if d not in set(labels)]) and sorted(got["list_append"]) == sorted(docs + [v for v in vecs if v not in set(docs)])
    assert sorted(got["intersect_lists"]) == sorted(set(docs) & set(labels))
    held = {r[0] for r in con.execute("SELECT s_suppkey FROM supplier").fetchall()}
    first = con.execute("SELECT user_id, min(event_id) FROM events GROUP BY user_id").fetchall()
    assert sorted((r.user_id, r.event_id) for r in QUERIES["insert_ignore"](spark, DIR).collect()) == sorted(x for x in first if x[0] not in held)
