"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting adds shallow trees on one feature (then one pair) at a time; what they add up to is one lookup
table a feature and a pair, so scoring is a sum of table entries of the features' bins.
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

#: Labelled rows that a fit takes at most (by hash of the id), bins, rounds, pairs of features.
MAX_ROWS, BINS, ROUNDS, PAIR_ROUNDS, PAIRS, COARSE, RATE = 20_000, 32, 150, 60, 6, 8, 0.1
CUT = 0.3
NAMES = ["log_chars", "upper", "digit", "punct", "symbol", "bang", "bar", "newline", "space", "non_ascii", "word_len", "distinct_words", "longest_word", "top_word", "marked_words", "short_words", "repeated_lines", "line_len", "stop_ends", "repeated_pairs"]
_byte_sets = {n: np.array([c in s for c in range(256)]) for n, s in {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "punct": b".,;:?'\"()-", "symbol": b"#$%&*@^~<>{}[]\\/=+_`", "bang": b"!", "bar": b"|", "newline": b"\n", "space": b" \t"}.items()}


def features(text: str | None) -> list[float]:
    """Figures of one whole text; all 0 but none missing where it is null or empty."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = float(len(raw))
    rate = {k: float(hist[v].sum()) / n for k, v in _byte_sets.items()}
    words, lines = text.split(), text.split("\n")
    w = float(max(1, len(words)))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    ends = Counter([x[-1] for x in words])
    marked = sum(c for k, c in ends.items() if not (k.isalnum() or k in ".,;:?'\"()-"))
    stops = sum(ends[k] for k in ".?")
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [np.log1p(len(text)), rate["upper"], rate["digit"], rate["punct"], rate["symbol"], rate["bang"], rate["bar"], rate["newline"], rate["space"], float(hist[128:].sum()) / n, float(lengths.mean()), len(counts) / w, float(lengths.max()), (max(counts.values()) if counts else 0) / w, marked / w, float((lengths <= 2).mean()), 1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), stops / w, 1 - pairs / max(1.0, w - 1)]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, x): the features of each whole text."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeping("quality")
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<float>")


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    cg, ch = g.cumsum()[:-1], h.cumsum()[:-1]
    G, H = g.sum(), h.sum()
    gain = cg**2 / (ch + lam) + (G - cg) ** 2 / (H - ch + lam) - G**2 / (H + lam)
    gain[(ch < 1) | (H - ch < 1)] = -1
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-1.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """A tree of at most three leaves over one feature's bins, as what each bin adds."""
    edges = [0, len(g)]
    for _ in range(2):
        gain, cut = max(((a, b + lo) for lo, hi in zip(edges, edges[1:], strict=False) for a, b in [_best_cut(g[lo:hi], h[lo:hi], lam)]), default=(-1.0, 0))
        if gain <= 1e-9:
            break
        edges = sorted({*edges, cut})
    out = np.zeros(len(g))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + lam)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> tuple[float, np.ndarray]:
    """The best four leaves from one cut of each of two features; its gain and what each cell adds."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    G, H, best = cg[-1, -1], ch[-1, -1], (-1.0, 0, 0)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b), (G - cg[:-1, -1:] - cg[-1:, :-1] + a, H - ch[:-1, -1:] - ch[-1:, :-1] + b)]
    gain = sum(x**2 / (y + lam) for x, y in quads) - G**2 / (H + lam)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    best = (float(gain[i, j]), int(i) + 1, int(j) + 1)
    out = np.zeros_like(g)
    for r in (slice(None, best[1]), slice(best[1], None)):
        for c in (slice(None, best[2]), slice(best[2], None)):
            out[r, c] = -g[r, c].sum() / (h[r, c].sum() + lam)
    return best[0], out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """x (rows, features), y 0 or 1 to edges, tables, pairs and intercept; without rows, all scores are 0.5."""
    if not len(y):
        return {"edges": [[]] * len(NAMES), "tables": [[0.0]] * len(NAMES), "pairs": [], "base": 0.0}
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1)
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    z = np.full(len(y), base)
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(ROUNDS):
        for f, t in enumerate(tables):
            q = 1 / (1 + np.exp(-z))
            step = RATE * shallow_tree(np.bincount(bins[:, f], q - y, len(t)), np.bincount(bins[:, f], q * (1 - q), len(t)))
            t += step
            z += step[bins[:, f]]
    coarse = [np.array([b * COARSE // len(t) for b in range(len(t))]) for t in tables]
    rough = np.stack([c[bins[:, f]] for f, c in enumerate(coarse)], 1)

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        cell = rough[:, a] * COARSE + rough[:, b]
        return pair_tree(*(np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (q - y, q * (1 - q))))

    ranked = sorted(((grid(a, b)[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)[:PAIRS]
    pairs = [[a, b, np.zeros((COARSE, COARSE))] for _, a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for pair in pairs:
            step = RATE * grid(pair[0], pair[1])[1]
            pair[2] += step
            z += step[rough[:, pair[0]], rough[:, pair[1]]]
    return {"edges": [e.tolist() for e in edges], "tables": [t.tolist() for t in tables], "pairs": [[a, b, t.tolist()] for a, b, t in pairs], "base": base}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["base"])
    rough = np.zeros(x.shape, np.int64)
    for f, (e, t) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        b = np.searchsorted(np.array(e), x[:, f], "right")
        z += np.array(t)[b]
        rough[:, f] = b * COARSE // len(t)
    for a, b, t in model["pairs"]:
        z += np.array(t)[rough[:, a], rough[:, b]]
    return 1 / (1 + np.exp(-z))


def sample(feats: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most MAX_ROWS labelled rows, those of least hash of their id. Conflicting labels of one id: the larger."""
    some = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    rows = feats.join(F.broadcast(some), "doc_id").orderBy("doc_id", "x").limit(2 * MAX_ROWS).toPandas()
    return (np.array(rows.x.tolist(), np.float64), (rows.y > 0).to_numpy(float)) if len(rows) else (np.zeros((0, len(NAMES))), np.zeros(0))


def scored(feats: DataFrame, model: dict) -> DataFrame:
    """(doc_id, x) to (doc_id, score, predicted)."""
    packed = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(packed)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(NAMES))
            p = score(m, x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every row of docs (doc_id, text) by a model of labels (doc_id, quality).

    Null and empty texts have features of 0 and a score as well. Labels of unknown documents count for nothing;
    repeated rows give repeated results; other columns are ignored; no labels at all: 0.5 for all.
    """
    feats = common.written(featured(docs), "quality")
    return scored(feats, fit(*sample(feats, labels)))
