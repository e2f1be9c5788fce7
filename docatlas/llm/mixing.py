"""Mixing to target weights with soft membership, in SQL functions only.

A classifier learned from labelled documents gives each document a posterior over domains. Nonnegative rates of
documents then bring the expected tokens of each domain to its target: those nearest to 1 that do, by projected
Newton steps whose sums over all documents Spark takes.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of the fit at most (by hash of the id): one half of them shows the markers, the other fits the posterior.
MAX_ROWS = 20_000
#: Markers of a domain at most, rows that must hold one, least log-ratios to the other domains of the two grades of markers, letters of a stem.
MARKERS, LEAST, GRADES, STEM = 200, 4, (1.5, 4.0), 5
#: Ridge on standardised features, and the log-odds of a domain of which no row is labelled.
RIDGE, UNSEEN = 1e-2, -14.0
#: Steps at most, the largest relative error of a domain's tokens that ends them, and the pull of rates to 1: it damps steps, and
#: decides where no rates meet all targets.
STEPS, CLOSE, PULL = 24, 1e-3, 1e-4
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}
#: What is counted of a text's shape, by the word.
SHAPES = {"capitals": "[A-Z]{2,}", "marks": r"[#$%&*@^~<>{}\[\]\\=+_`!|]+", "digits": "[0-9]+"}
FIGURES = len(SHAPES) + 6


def domains(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) to (doc_id, domain); contradicting rows of one id: the worst."""
    worst = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.min("quality").alias("q"))
    return worst.select("doc_id", F.when(F.col("t") > 0, "toxic").when(F.col("q") < 1, "low").otherwise("clean").alias("domain"))


def described(docs: DataFrame, *more: str) -> DataFrame:
    """(..., text) to (..., tokens, terms, shape): words (one at least), distinct words and stems, and the figures of a whole text."""
    w = docs.select("*", F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), "").alias("ws"))
    w = w.select("*", F.array_distinct("ws").alias("once"))
    n = F.greatest(F.lit(1.0), F.size("ws").cast("double"))
    stems = F.transform(F.filter("once", lambda x: F.length(x) > STEM), lambda x: F.concat(F.lit("^"), F.substring(x, 1, STEM)))
    counted = [F.sqrt(F.regexp_count("text", F.lit(p)) / n) for p in SHAPES.values()]
    lines = F.split("text", "\n")
    figures = [*counted, F.size(lines) / n, F.size("once") / n, F.size(F.array_distinct(lines)) / F.size(lines), F.log1p(n), F.log1p(F.size("once").cast("double")), F.length("text") / n / 10]
    return w.select(*more, n.cast("long").alias("tokens"), F.concat("once", stems).alias("terms"), F.array(*figures).alias("shape"))


def markers(half: DataFrame, names: list[str], scratch: common.Scratch) -> list[list[str]]:
    """For each domain and grade the words and stems that speak for it most: those of the largest p log(p/q), p and q being the shares of rows that hold one in the domain and elsewhere."""
    sizes = {r.domain: r["count"] for r in half.groupBy("domain").count().collect()}
    held = scratch.written(half.select("domain", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names))), "mixing-terms")
    out, rows = [], sum(sizes.values())
    for i, d in enumerate(names):
        own = sizes.get(d, 0)
        p = (F.col(f"n{i}") + 0.5) / (own + 1.0)
        q = (sum(F.col(f"n{j}") for j in range(len(names)) if j != i) + F.lit(0.5)) / (rows - own + 1.0)
        told = held.where(F.col(f"n{i}") >= LEAST).select("term", F.log(p / q).alias("w"), (p * F.log(p / q)).alias("g")).where(F.col("w") >= GRADES[0]).orderBy(F.desc("g"), "term").limit(MARKERS).collect()
        out += [[r.term for r in told if lo <= r.w < hi] for lo, hi in zip(GRADES, (*GRADES[1:], np.inf), strict=True)]
    return out


def features(rows: DataFrame, lists: list[list[str]], *more: str) -> DataFrame:
    """(..., terms, shape) to (..., x): the shape of a text and, for each list of markers, the log of how many of them it holds."""
    split = lambda words: F.split(F.lit(" ".join(words)), " ")
    known = sorted({x for words in lists for x in words})
    held = rows.select(*more, "shape", F.array_intersect(split(known), "terms").alias("held"))
    n = [F.log1p(F.size(F.array_intersect(split(x), "held")).cast("double")) if x else F.lit(0.0) for x in lists]
    return held.select(*more, F.concat("shape", F.array(*n)).alias("x"))


def softmax(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge multinomial regression of classes y on x by Newton's method: weights (k - 1, features + 1) against class 0, and what x is centred and scaled by."""
    mid, wide = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack(((x - mid) / wide, np.ones(len(x))))
    m = z.shape[1]
    ridge = np.tile(np.append(np.full(m - 1, RIDGE * np.sqrt(len(x))), 1e-3), k - 1)
    hit = np.stack([y == c for c in range(1, k)], 1).astype(float)
    w = np.zeros((k - 1) * m)

    def odds(w: np.ndarray) -> tuple[np.ndarray, float]:
        s = np.column_stack((np.zeros(len(z)), z @ w.reshape(k - 1, m).T))
        top = s.max(1, keepdims=True)
        e = np.exp(s - top)
        total = e.sum(1, keepdims=True)
        loss = float((np.log(total[:, 0]) + top[:, 0] - (s[:, 1:] * hit).sum(1)).sum() + (ridge * w * w).sum() / 2)
        return (e / total)[:, 1:], loss

    p, loss = odds(w)
    for _ in range(60):
        slope = ((p - hit).T @ z).ravel() + ridge * w
        curve = np.diag(ridge)
        for a in range(k - 1):
            for b in range(k - 1):
                curve[a * m : (a + 1) * m, b * m : (b + 1) * m] += (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6:
            q, now = odds(w - size * step)
            if now <= loss:
                break
            size /= 2
        done = loss - now < 1e-6 * max(1.0, loss)
        w, p, loss = w - size * step, q, now
        if done:
            break
    return w.reshape(k - 1, m), mid, wide


def fit(docs: DataFrame, labelled: DataFrame, names: list[str]) -> tuple[list[list[str]], list[list[float]]]:
    """Markers, and weights of the features and a constant for each of names, from at most MAX_ROWS labelled rows."""
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        some = labelled.where(F.col("domain").isin(names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
        rows = scratch.written(described(docs.join(F.broadcast(some), "doc_id"), "doc_id", "domain"), "mixing-sample")
        odd = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
        lists = markers(rows.where(odd == 0), names, scratch)
        got = features(rows.where(odd == 1), lists, "domain").limit(MAX_ROWS).collect()
    seen = [d for d in names if any(r.domain == d for r in got)]
    width = FIGURES + len(lists)
    if len(seen) < 2:  # nothing to tell apart
        return lists, [[0.0] * width + [0.0 if not seen or d in seen else UNSEEN] for d in names]
    w, mid, wide = softmax(np.array([r.x for r in got]), np.array([seen.index(r.domain) for r in got]), len(seen))
    rows_ = dict(zip(seen, [[0.0] * (width + 1), *([*(v[:-1] / wide).tolist(), float(v[-1] - (v[:-1] * mid / wide).sum())] for v in w)], strict=True))
    return lists, [rows_.get(d, [0.0] * width + [UNSEEN]) for d in names]


def posteriors(docs: DataFrame, model: tuple, names: list[str], *more: str) -> DataFrame:
    """(..., text) to (..., tokens, p): words of each whole text and its posterior over names."""
    lists, weights = model
    x = features(described(docs, *more), lists, *more, "tokens")
    z = [sum((F.get("x", F.lit(i)) * v for i, v in enumerate(row[:-1]) if v), F.lit(row[-1])) for row in weights]
    x = x.select(*more, "tokens", F.array(*z).alias("z"))
    x = x.select(*more, "tokens", F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return x.select(*more, "tokens", F.transform("e", lambda v: v / total).alias("p"))


def rates(soft: DataFrame, weights: list[float], budget: float | None = None) -> tuple[Column, list[float], list[float]]:
    """The rate of each row of soft (tokens, p) as a column, the domain tokens it gives and the targets.

    budget: tokens wanted in all; by default those at which the domain of the largest target is used just once.
    The nonnegative rates nearest to 1 that meet the targets are max(0, 1 + level . p), with levels that minimise a
    convex function of as many variables as domains; its slope and curvature are sums over all rows. Where the steps
    do not close on the targets, the rates are those of least squares with PULL, and a warning tells what they give.
    """
    k = len(weights)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.get("p", F.lit(i)) for i in range(k)]

    def rate(level: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) + sum(x * float(v) for x, v in zip(p, level, strict=True)))

    def took(level: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the tokens times squared rates, domain tokens and curvature at a level."""
        rows = soft.select("tokens", "p", rate(level).alias("r"))
        n, live = F.col("tokens") * F.col("r"), F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        row = rows.agg(F.sum(n * F.col("r") / 2), *(F.sum(n * x) for x in p), *(F.sum(live * p[i] * p[j]) for i, j in pairs)).first()
        half, *sums = [float(x or 0.0) for x in row]
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, sums[k:], strict=True):
            curve[i, j] = curve[j, i] = x
        return half, np.array(sums[:k]), curve

    start = took(np.zeros(k))
    have = start[1]
    total = float(have.sum()) or 1.0
    if not have.any():
        return F.lit(1.0), have.tolist(), [0.0] * k
    scale = sum(weights)
    if budget is None:
        w, h = max(zip(weights, have.tolist(), strict=True))
        budget = h / (w / scale) if w > 0 and h > 0 else total
    target = np.array([w / scale * budget for w in weights])
    damp = PULL * np.maximum(have, 1e-6 * total)

    def off(now: np.ndarray) -> float:
        return float((abs(now - target) / np.maximum(target, 1e-3 * total)).max())

    def height(half: float, level: np.ndarray, pull: np.ndarray) -> float:
        return half - level @ target + (pull * level**2).sum() / 2

    def solved(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Newton steps, damped more after one that did not lead down."""
        level, (half, now, curve), more = np.zeros(k), start, 1.0
        for _ in range(STEPS):
            slope = target - now - pull * level
            if off(now) <= CLOSE or (abs(slope) <= 1e-9 * total).all():
                break
            step = np.linalg.solve(curve + np.diag(np.maximum(pull, more * damp)), slope)
            tried = level + step
            got = took(tried)
            if height(got[0], tried, pull) <= height(half, level, pull):
                level, (half, now, curve), more = tried, got, max(1.0, more / 100)
            else:
                more *= 30
        return level, now

    level, now = solved(np.zeros(k))
    if off(now) > CLOSE:
        level, now = solved(damp)
        if off(now) > CLOSE:
            warnings.warn(f"mixing: rates give {now.tolist()} tokens of the domains, targets are {target.tolist()}", stacklevel=2)
    return rate(level), now.tolist(), target.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, keep: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, tokens, p_<domain>, domain, rate, copies), with keep as a struct of that name of all columns of docs besides.

    copies is rate rounded up or down by a hash of the document, so that its mean is the rate. Null and empty texts
    count as one word and have the posterior of a text without marks; texts of any length are read whole. Repeated rows
    are rows of their own with equal rates; a row without an id counts as any other but teaches nothing. Of equally
    likely domains a document's is the first by name. Without labels all posteriors are equal; a domain without any has next to
    none; targets that the rates do not reach are told by a warning; domains of no target weigh nothing; other
    columns are ignored; an empty table gives no rows.
    """
    names = sorted(targets)
    own = [F.struct(*docs.columns).alias(keep)] if keep else []
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *own)
    d = d.withColumn("u", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30))
    more = ["doc_id", "u", *([keep] if keep else [])]
    soft = common.written(posteriors(d, fit(d.select("doc_id", "text"), labelled, names), names, *more), "mixing")
    rate, _, _ = rates(soft, [float(targets[n]) for n in names])
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int"))
    p = [F.get("p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)]
    mixed = soft.withColumn("rate", rate)
    return mixed.select("doc_id", *([keep] if keep else []), "tokens", *p, best.alias("domain"), "rate", F.floor(F.col("rate") + F.col("u")).cast("long").alias("copies"))


def report(mixed: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(domain, target, reached, by_label): shares of tokens wanted, given by the posteriors, and found among the labelled documents."""
    names = sorted(targets)
    whole = float(sum(targets.values()))
    n = F.col("tokens") * F.col("rate")
    sums = mixed.agg(*(F.sum(n * F.col(f"p_{d}")).alias(d) for d in names))
    told = mixed.join(labelled.select("doc_id", F.col("domain").alias("label")), "doc_id").agg(*(F.sum(F.when(F.col("label") == d, n).otherwise(0.0)).alias(d) for d in names))
    shares = [df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), (F.col(d) / sum(F.col(x) for x in names)).alias(c)) for d in names))).alias("s")).select("s.*") for df, c in ((sums, "reached"), (told, "by_label"))]
    want = F.coalesce(*(F.when(F.col("domain") == d, float(v) / whole) for d, v in targets.items()))
    return shares[0].join(shares[1], "domain").select("domain", want.alias("target"), "reached", "by_label")
