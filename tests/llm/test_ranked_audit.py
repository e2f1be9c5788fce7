"""Search, audit and toxicity against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docatlas.llm import divergence, ranked, toxicity

rng = random.Random(8)
VOCAB = [f"{a}{b}{c}" for a in ("ka", "lo", "Mi", "nü") for b in ("", "re", "sti", "7") for c in ("", "n", "ß")]


def prose(n, words=VOCAB):
    return " ".join(rng.choice(words) + rng.choice(["", ".", ", x", "-"]) for _ in range(n))


SAME = prose(30)
TEXTS = [None, "", " .. ", "42", SAME, SAME, SAME.upper(), prose(20_000), "İ ΣΣ ß 😀 a1b2", "a\x00b\x7fc"] + [prose(rng.randint(1, 60)) for _ in range(90)]
ROWS = [(None if i == 20 else i * 3 - 6, t, rng.choice(["en", "en", "de", None, "fr"]), None if i % 11 == 0 else f"s{i % 4}", 1.0, "x", 5) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[30], ROWS[31], ROWS[30]]
SCHEMA = "doc_id long, text string, lang string, source string, score double, term string, uid int"
ITEMS = [(1, "ka lo lo"), (2, None), (3, ""), (4, "zzz none"), (5, SAME), (6, "x"), (7, "nüß KA ka. 42"), (1, "lostin x"), (None, "ka"), (8, prose(300))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_search(rows, items, k=10):
    ws = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(r[1])) for r in rows]
    n, length = sum(bool(w) for w in ws), sum(map(len, ws))
    tf = [Counter(w) for w in ws]
    df = Counter(t for c in tf for t in c)
    want = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            want[i].update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t)))
    out = []
    for item, q in want.items():
        scored = []
        for r, c, w in zip(rows, tf, ws, strict=True):
            m = 25 + (75 * len(w) * n) // length if w else 1
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if s > 0:
                scored.append((-s, r[0] is None, r[0] or 0))
        out += [(item, rank, None if x[1] else x[2], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("k", [1, 10, 200])
def test_search_equals_a_full_scan(spark, docs, k):
    items = spark.createDataFrame([(*i, 9) for i in ITEMS], "item_id long, text string, rank int")
    assert found(ranked.search(docs, items, k)) == brute_search(ROWS, ITEMS, k)


def test_search_without_broadcasts_and_in_passes(spark, docs, monkeypatch):
    for name, v in (("SMALL", 0), ("VOCABULARY", 60), ("HEAD", 1)):
        monkeypatch.setattr(ranked, name, v)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(ranked.search(docs, items)) == brute_search(ROWS, ITEMS)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(docs.limit(0), items).collect() == [] and ranked.search(docs, items.limit(0)).collect() == []


def test_ties_rank_by_id(spark):
    rows = [(i, "alpha beta" if i % 2 else "alpha gamma", None, None, 0.0, "", 0) for i in range(40, 0, -1)] + [(99, "other", None, None, 0.0, "", 0)]
    got = found(ranked.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "alpha")], "item_id long, text string")))
    assert [r[2] for r in got] == list(range(1, 11)) and len({r[3] for r in got}) == 1


def brute_audit(rows, least):
    groups, counts, held = set(), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups.add((lang, source))
        ws = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(r[1]))
        counts[lang, source].update(ws)
        held[lang].update(set(ws))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=lambda t: t.encode())
        sources = sorted(g[1] for g in groups if g[0] == lang)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept]

        own = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(own[s], own[o], strict=True)), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted((b - a, t) for t, a, b in zip(kept, own[s], q, strict=True) if counts[lang, s][t] and a > b)[:50]
            out += [(lang, s, "term", t, -v, i) for i, (v, t) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [30, 2, 1, 10_000])
def test_audit_equals_plain_counting(docs, least):
    assert sorted(map(tuple, divergence.audit(docs, least).collect())) == brute_audit(ROWS, least)


def test_audit_in_levels_of_shards(docs, monkeypatch):
    for name, v in (("SHARDS", 2), ("SHARD_DOCS", 5), ("FAN", 4), ("SPREAD", 2), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, v)
    assert sorted(map(tuple, divergence.audit(docs, 2).collect())) == brute_audit(ROWS, 2)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_risk_never_counts_as_negative():
    r = np.random.default_rng(1)
    pos, unl = r.normal(2, 1, (60, toxicity.WIDTH)), np.vstack((r.normal(2, 1, (40, toxicity.WIDTH)), r.normal(-2, 1, (360, toxicity.WIDTH))))
    net = toxicity.learn(pos, unl, 0.1)
    assert toxicity.score(net, r.normal(2, 1, (200, toxicity.WIDTH)), 0.1).mean() > 0.8
    assert toxicity.score(net, r.normal(-2, 1, (200, toxicity.WIDTH)), 0.1).mean() < 0.1
    assert (toxicity.score(None, pos, 0.1) == 0.1).all()


def test_lexicon_takes_the_prior_from_unlabelled_shares():
    rows = [("bad", 2.0, 20, 0.4, 4), ("the", 2.0, 20, 20.0, 200), ("rare", 0.05, 2, 0.0, 0)]
    got = toxicity.lexicon(rows, np.array([20.0, 200.0]), np.array([0.05, 0.05]), 0.02)
    assert got["bad"] == len(toxicity.GRADES) and "the" not in got and "rare" not in got
    assert toxicity.lexicon(rows, np.array([0.0, 5.0]), np.array([0.0, 0.1]), 0.02) == {}


def test_toxic_texts_are_found(spark):
    plain = [f"{a}{b}" for a in ("ver", "sto", "lin", "mar", "ten") for b in ("a", "en", "ung", "er")]
    bad = ["grobian", "grobiane", "schuft"]

    def text(toxic, n):
        return " ".join(rng.choice(bad) if toxic and rng.random() < 0.08 else rng.choice(plain) for _ in range(n))

    rows = [(i, text(i % 8 == 0, rng.randint(40, 400)), float(i), "x") for i in range(400)] + [(-1, None, 0.0, "x"), (-2, "", 0.0, "x"), (-3, text(False, 30_000), 0.0, "x"), (-4, "SCHUFT! Grobian. schuft, du grobian", 0.0, "x"), (None, "grobian schuft", 0.0, "x"), (7, text(False, 50), 0.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, side string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0), 1) for i in range(0, 200)] + [(8, 0, 1), (None, 1, 1), (5, None, 0), (999_999, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    tested = [r for r in got if r.doc_id is not None and r.doc_id >= 200]
    hits = sum(r.predicted for r in tested if r.doc_id % 8 == 0)
    assert hits >= 0.9 * sum(r.doc_id % 8 == 0 for r in tested) and not any(r.predicted for r in tested if r.doc_id % 8)
    by = {r.doc_id: r.predicted for r in got}
    assert by[-4] == by[None] == 1 and by[-1] == by[-2] == by[-3] == 0
    assert toxicity.classify(docs.limit(0), labels, docs).collect() == []
    none = toxicity.classify(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert {round(r.score, 9) for r in toxicity.classify(docs, labels.limit(0)).collect()} == {toxicity.UNKNOWN_PRIOR}
