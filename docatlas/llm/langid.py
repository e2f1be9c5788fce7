"""Language ID by cross-parsing entropy.

A suffix automaton is built from labelled text of each language. A text is parsed against each automaton into
phrases, each the longest match that the automaton follows plus the restart; the language that needs the fewest
phrases, normalised by the size of its automaton's text and the parsed length, wins.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bounds of the fit: languages (those of most labelled rows), documents and symbols of each. All chosen documents of a language give
#: slices of equal size, each from a place in the whole text that a hash of its id tells. The model is no larger than their product.
MAX_LANGS, DOCS_PER_LANG, SYMBOLS_PER_LANG = 64, 96, 20_000
#: Symbols that are parsed as one strip; phrases end with it.
WINDOW = 512
#: Letters told apart at most: the most frequent of the fit. Besides, 0 is "no letter" and the last symbol any other letter.
ALPHABET = 250
_letters = None


def letters_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def squeezed(text: str) -> np.ndarray:
    """Code points of letters; any run of others is one 0."""
    c = code_points(text)
    c = np.where(letters_table()[c], c, 0)
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))] if len(c) else c


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of symbols, -1 where there is none; state 0 is the root."""
    n = 2 * len(symbols) + 2
    go = np.full((n, width), -1, np.int32)
    link, length = [-1] * n, [0] * n
    last, size = 0, 1
    for s in symbols:
        cur, size = size, size + 1
        length[cur] = length[last] + 1
        p = last
        while p != -1 and go[p, s] < 0:
            go[p, s] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = int(go[p, s])
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin, size = size, size + 1
                go[twin], link[twin], length[twin] = go[q], link[q], length[p] + 1
                while p != -1 and go[p, s] == q:
                    go[p, s] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go[:size]


class Parser:
    """All languages' automata in one flat table: entry (target * width) << 1 | "a phrase ended"."""

    def __init__(self, model: dict):
        self.langs, self.width = model["langs"], len(model["letters"]) + 2
        self.map = np.full(0x110000, self.width - 1, np.uint8)
        self.map[0] = 0
        for i, c in enumerate(model["letters"]):
            self.map[c] = i + 1
        flat, base, self.roots, self.bits = [], 0, [], []
        for text in model["texts"]:
            symbols = self.map[np.array(text, np.uint32)].tolist() if text else []
            go = automaton(symbols, self.width)
            again = np.where(go[0] < 0, 0, go[0])
            to = np.where(go < 0, again[None, :], go).astype(np.int64)
            flat.append((((to + base) * self.width) << 1 | (go < 0)).astype(np.int32).ravel())
            self.roots.append(base * self.width)
            self.bits.append(math.log2(len(symbols) + 2))
            base += len(go)
        self.table = np.concatenate(flat)

    def phrases(self, strips: np.ndarray) -> np.ndarray:
        """strips: (window, strips) of symbols, 255 beyond the end. Phrases of each strip and language."""
        state = np.repeat(np.array(self.roots, np.int32)[:, None], strips.shape[1], 1)
        count = np.ones(state.shape, np.int32)
        for row in strips:
            live = row != 255
            if live.all():
                v = self.table[state + row]
                count += v & 1
                state = v >> 1
            elif live.any():
                v = self.table[state[:, live] + row[live]]
                count[:, live] += v & 1
                state[:, live] = v >> 1
            else:
                break
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        symbols = [self.map[squeezed(t)] if t else np.zeros(0, np.uint8) for t in texts]
        has = np.array([bool(s.any()) for s in symbols], bool)
        owner = np.repeat(np.arange(len(texts)), [-(-len(s) // WINDOW) if h else 0 for s, h in zip(symbols, has, strict=True)])
        strips = np.full((len(owner), WINDOW), 255, np.uint8)
        at = 0
        for s, h in zip(symbols, has, strict=True):
            if h:
                n = -(-len(s) // WINDOW)
                strips[at : at + n].ravel()[: len(s)] = s
                at += n
        total = np.zeros((len(self.langs), len(texts)))
        size = (strips != 255).sum(1)
        order = np.argsort(-size, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 4096)):
            if len(part):
                got = self.phrases(np.ascontiguousarray(strips[part].T[: size[part[0]]]))
                for k in range(len(self.langs)):
                    total[k] += np.bincount(owner[part], got[k], len(texts))
        bits = total * np.array(self.bits)[:, None]
        best = bits.argmin(0)
        p = np.exp2(-np.clip(0.25 * (bits - bits.min(0)), 0, 60))
        score = np.where(has, p.max(0) / p.sum(0), 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], score


_parsers: dict[str, Parser] = {}


def _parser(model: str) -> Parser:
    common.keeping("langid", _parsers.clear)
    if model not in _parsers:
        _parsers.clear()
        _parsers[model] = Parser(json.loads(model))
    return _parsers[model]


def fit(labelled: DataFrame) -> str:
    """labelled (doc_id, text, lang) to a model of bounded size, see MAX_LANGS and what follows it. Rows without text or lang teach nothing."""
    known = labelled.where("lang is not null and text is not null")
    langs = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()]
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = known.where(F.col("lang").isin(langs)).select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= DOCS_PER_LANG).select("lang", "doc_id").collect()
    if not picked:
        return json.dumps({"langs": [], "letters": [], "texts": []})
    share = {k: -(-SYMBOLS_PER_LANG // n) for k, n in Counter(r.lang for r in picked).items()}
    take = 2 * F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")]
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - take + 1)).cast("int") + 1
    ids = sorted({r.doc_id for r in picked if r.doc_id is not None})
    rows = known.where(F.col("doc_id").isin(ids) & F.col("lang").isin(list(share))).select("doc_id", "lang", F.col("text").substr(start, take).alias("text")).distinct().collect()
    by: dict[str, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)):
        s = squeezed(r.text)
        if s.any():
            by.setdefault(r.lang, []).append(s[: share[r.lang]])
    langs = [k for k in langs if k in by]
    texts = [np.concatenate(by[k])[:SYMBOLS_PER_LANG].tolist() for k in langs]
    letters = [c for c, _ in Counter(c for t in texts for c in t if c).most_common(ALPHABET)]
    return json.dumps({"langs": langs, "letters": letters, "texts": texts})


def detect(docs: DataFrame, model: str, keep: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score), with keep as a struct of that name of all columns of docs besides.

    Whole texts of any length are parsed in the tasks that read them; nothing is shuffled. Null, empty and letterless
    texts are "und" with score 0. Ties go to the language of more labelled rows. Repeated rows give repeated results,
    rows without an id results without one; other columns are ignored; an empty table gives no rows, an empty model
    all "und".
    """
    common.tune(docs.sparkSession)
    own = [F.struct(*docs.columns).alias(keep)] if keep else []
    kept = ["doc_id", *([keep] if keep else [])]
    d = docs.select(F.col("doc_id").cast("long"), *own, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = not json.loads(model)["langs"]
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, score = (["und"] * len(texts), np.zeros(len(texts))) if none else _parser(model).predict(texts)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    schema = T.StructType([*d.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return d.mapInArrow(run, schema)
