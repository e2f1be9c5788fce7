"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones show which words and word beginnings speak for toxicity; a text is described by how
many of its words do, by grade. A small network learns from the two sets alone: its risk on negatives is that on unlabelled
texts less the share that the class prior gives to positives, and never counts as less than 0.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts of the fit at most (by hash of the id): confirmed ones and unlabelled ones.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000
#: Letters of word beginnings, confirmed texts that hold a marker at least, markers at most, least log-ratios of grades, deviations by which a count is taken for less.
STARTS, LEAST, MARKERS, GRADES, DOUBT = range(3, 9), 3, 6_000, (1.5, 2.5, 3.5, 4.5), 1.5
#: Units, steps and step size of the network, and its ridge.
UNITS, STEPS, RATE, RIDGE = 12, 600, 0.02, 1e-3
CUT, UNKNOWN_PRIOR, SEED = 0.7, 0.05, 11
#: Counts of markers that a task holds before it passes them on.
HELD = 400_000
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text in lower case; letters beyond ASCII belong to them, ASCII digits and marks do not."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split() if text else []


def marks(word: bytes) -> list[str]:
    """A word, which ends with a dot, and its beginnings."""
    w = word.decode("utf-8", "replace")
    return [w + ".", *(w[:i] for i in STARTS if i <= len(w))]


def _counted(rows: DataFrame) -> DataFrame:
    """(part, side, text) to (mark, part, side, share, texts): in each half of positive and unlabelled texts the sum of a mark's shares of words, and how many hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeping("toxicity")
        share: dict[tuple[str, int, int], float] = {}
        texts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(share)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)), pa.array([share[k] for k in keys], pa.float64()), pa.array([texts[k] for k in keys], pa.int64())], ["mark", "part", "side", "share", "texts"])
            share.clear()
            texts.clear()
            return out

        for b in batches:
            for part, side, text in zip(*(b.column(c).to_pylist() for c in ("part", "side", "text")), strict=True):
                ws = words(text)
                seen: Counter = Counter()
                for w, n in Counter(ws).items():
                    for m in marks(w):
                        seen[m] += n
                for m, n in seen.items():
                    k = (m, part, side)
                    share[k] = share.get(k, 0.0) + round(n / len(ws), 9)
                    texts[k] += 1
                if len(share) >= HELD:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "mark string, part int, side int, share double, texts long")


def lexicon(found: list, n: np.ndarray, unit: np.ndarray, prior: float) -> dict[str, int]:
    """Marks to grades. found: rows (mark, share and texts of positives, of unlabelled); n: texts of both; unit: their mean share of a single word.

    Shares among negatives are those among unlabelled texts less what the prior gives to positives.
    """
    if not n[0] or not n[1]:
        return {}
    out = {}
    for mark, ps, pt, us, _ in found:
        if pt < LEAST:
            continue
        p = ps * max(0.0, 1 - DOUBT / pt**0.5) / n[0]
        q = max(0.0, us / n[1] - prior * ps / n[0]) / (1 - prior) + 0.5 * unit[1] / n[1]
        if p > 0 and (grade := sum(np.log(p / q) >= g for g in GRADES)):
            out[mark] = int(grade)
    return out


class Reader:
    """Figures of texts by a lexicon; what is known of a word is kept, up to a bound."""

    def __init__(self, grades: dict[str, int]):
        self.grades, self.known = grades, {}

    def figures(self, text: str | None) -> list[float]:
        n, distinct, total = [0] * (len(GRADES) + 1), [0] * (len(GRADES) + 1), 0
        for w, c in Counter(words(text)).items():
            g = self.known.get(w)
            if g is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                g = self.known[w] = max((self.grades.get(m, 0) for m in marks(w)), default=0)
            n[g] += c
            distinct[g] += 1
            total += c
        return [v for g in range(1, len(n)) for v in (np.log1p(n[g]), np.log1p(distinct[g]), (n[g] / max(1, total)) ** 0.5)] + [np.log1p(total)]


WIDTH = 3 * len(GRADES) + 1


def learn(pos: np.ndarray, unl: np.ndarray, prior: float) -> dict:
    """The network that minimises the non-negative risk of positive and unlabelled figures, by Adam over all rows."""
    both = np.vstack((pos, unl))
    mid, wide = both.mean(0), np.maximum(both.std(0), 1e-6)
    z, k = (both - mid) / wide, len(pos)
    r = np.random.default_rng(SEED)
    w = [r.normal(0, 0.3, (z.shape[1], UNITS)), np.zeros(UNITS), r.normal(0, 0.3, UNITS), np.array(0.0)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ w[0] + w[1])
        p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
        lost = -np.log1p(-np.minimum(p, 1 - 1e-12))  # logistic loss of calling a text clean
        rest = lost[k:].mean() - prior * lost[:k].mean()
        g = np.empty(len(z))
        if rest >= 0:
            g[:k] = prior * ((p[:k] - 1) - p[:k]) / k
            g[k:] = p[k:] / len(unl)
        else:  # the risk on negatives has gone below 0: take it back up
            g[:k] = prior * p[:k] / k
            g[k:] = -p[k:] / len(unl)
        back = g[:, None] * w[2] * (1 - h * h)
        slopes = [z.T @ back + RIDGE * w[0], back.sum(0), h.T @ g + RIDGE * w[2], g.sum()]
        for i, s in enumerate(slopes):
            m[i], v[i] = 0.9 * m[i] + 0.1 * s, 0.999 * v[i] + 0.001 * s * s
            w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return {"mid": mid.tolist(), "wide": wide.tolist(), "w": [x.tolist() for x in w]}


def score(net: dict | None, x: np.ndarray, prior: float) -> np.ndarray:
    if net is None:
        return np.full(len(x), prior)
    a, b, c, d = (np.array(v) for v in net["w"])
    return 1 / (1 + np.exp(-np.clip(np.tanh((x - net["mid"]) / net["wide"] @ a + b) @ c + d, -30, 30)))


def _figures(rows: DataFrame, grades: list[dict[str, int]]) -> DataFrame:
    """(part, side, text) to (side, x) by the lexicon of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeping("toxicity")
        readers = [Reader(g) for g in grades]
        for b in batches:
            x = [readers[1 - p].figures(t) for p, t in zip(b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("side"), pa.array(x, pa.list_(pa.float64()))], ["side", "x"])

    return rows.mapInArrow(run, "side int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> str:
    """A model from confirmed toxic rows of labels (doc_id, toxic) and docs (doc_id, text) as unlabelled texts.

    prior: the share of toxic texts, by default that among labelled rows; labels say nothing else of texts that are not
    toxic. Of contradicting labels of one id the larger counts.
    """
    spark = docs.sparkSession
    common.tune(spark)
    told = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    if prior is None:
        n, hit = told.agg(F.count("*"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0))).first()
        prior = min(0.5, (hit or 0) / n) if n else UNKNOWN_PRIOR
    by = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    confirmed = told.where("y > 0").orderBy(*by).limit(MAX_POSITIVE).select("doc_id", F.lit(0).alias("side"))
    some = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().orderBy(*by).limit(MAX_UNLABELLED).select("doc_id", F.lit(1).alias("side"))
    with common.Scratch(spark) as scratch:
        chosen = scratch.written(confirmed.unionAll(some), "toxicity-chosen")  # MAX_POSITIVE + MAX_UNLABELLED rows at most
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
        rows = scratch.written(texts.select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("part"), "side", "text"), "toxicity-texts")
        size = F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"[\p{L}]+")))
        about = {(r.part, r.side): (r.n, r.unit) for r in rows.where("text is not null").groupBy("part", "side").agg(F.count("*").alias("n"), F.avg(1 / size).alias("unit")).collect()}
        cells = [F.sum(F.when((F.col("part") == p) & (F.col("side") == s), F.col(c)).otherwise(0)).alias(f"{c}{p}{s}") for p in (0, 1) for s in (0, 1) for c in ("share", "texts")]
        sums = _counted(rows).groupBy("mark").agg(*cells)
        n = np.array([[about.get((p, s), (0, 0.0))[0] for s in (0, 1)] for p in (0, 1)], float)
        lift = (F.col("share00") + F.col("share10")) / max(1.0, n[:, 0].sum()) / ((F.col("share01") + F.col("share11")) / max(1.0, n[:, 1].sum()) + 1e-7)
        held = F.col("texts00") + F.col("texts10")
        found = sums.where(held >= LEAST).withColumn("lift", lift).where(F.col("lift") >= 1.5).orderBy(F.desc(held * F.log("lift")), "mark").limit(MARKERS).collect()
        unit = np.array([[about.get((p, s), (0, 0.0))[1] or 0.0 for s in (0, 1)] for p in (0, 1)])
        half = [lexicon([(r.mark, *(r[f"{c}{p}{s}"] for s in (0, 1) for c in ("share", "texts"))) for r in found], n[p], unit[p], prior) for p in (0, 1)]
        whole = lexicon([(r.mark, *(r[f"{c}0{s}"] + r[f"{c}1{s}"] for s in (0, 1) for c in ("share", "texts"))) for r in found], n.sum(0), (n * unit).sum(0) / np.maximum(1, n.sum(0)), prior)
        x = _figures(rows, half).toPandas()
    pos, unl = (np.array(x.x[x.side == s].tolist(), np.float64).reshape(-1, WIDTH) for s in (0, 1))
    order = lambda m: m[np.lexsort(m.T)]  # noqa: E731  the same sums whatever task came first
    net = learn(order(pos), order(unl), prior) if len(pos) and len(unl) and prior else None
    return json.dumps({"prior": prior, "grades": whole, "net": net})


def scored(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) to (doc_id, score, predicted) by a model."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeping("toxicity")
        m = json.loads(model)
        reader = Reader(m["grades"])
        for b in batches:
            if b.num_rows:
                p = score(m["net"], np.array([reader.figures(t) for t in b.column("text").to_pylist()]), m["prior"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame | None = None, prior: float | None = None) -> DataFrame:
    """Scores every row of docs (doc_id, text) by a model of labels (doc_id, toxic) and unlabelled texts (by default docs).

    Null and empty texts have figures of 0 and a score as well; texts of any length are read whole; repeated rows give
    repeated results; a score at the cut counts as toxic; rows without an id are scored and teach nothing; without
    confirmed texts all scores are the prior; other columns are ignored; an empty table gives no rows.
    """
    return scored(docs, fit(docs if unlabelled is None else unlabelled, labels, prior))
