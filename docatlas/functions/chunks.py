"""Chunkers: ordered folds inside one document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bounded(sentences: list[str], most: int = 2000) -> list[str]:
    """Sentences joined greedily; a chunk closes before it would exceed `most`, and no sentence is split."""
    out, held = [], ""
    for s in sentences:
        if held and len(held) + len(s) > most:
            out.append(held.strip())
            held = ""
        held += s + " "
    return [*out, held.strip()] if held.strip() else out


def sliding(text: str, least: int = 350, overlap: int = 1) -> list[str]:
    """Windows that close at `least` words and carry the last sentence on; the tail can be that sentence alone."""
    out, held, words = [], [], 0
    for s in re.split(r"(?<=[.?!])(?:\s+|$)", text):
        if not s.strip():
            continue
        held.append(s.strip())
        words += len(s.split())
        if words >= least:
            out.append(" ".join(held))
            held = held[-overlap:]
            words = sum(len(x.split()) for x in held)
    return [*out, " ".join(held)] if held else out


def with_dots(sentences: list[str]) -> list[str]:
    """Up to three dots that stand alone, or before a sentence's own text, go to the sentence before; the first has none."""
    out, dots = [], ""
    for i in range(len(sentences) - 1, -1, -1):
        s, dots = sentences[i] + dots, ""
        bare = s.strip()
        n = len(bare) - len(bare.lstrip("."))
        if i and 0 < n <= 3:
            dots, s = bare[:n], bare[n:].lstrip()
            if not s:
                continue
        out.append(s)
    return out[::-1]


def _udf(fn):
    """A function of one row's value, made where a session is there, not where the module is read. A few rows at a time are in Python: texts make batches of thousands large."""
    return F.udf(fn, T.ArrayType(T.StringType()), useArrow=False)


def bounded_column(sentences: Column, most: int = 2000) -> Column:
    """bounded() as a fold in the JVM; no chunks for null."""
    zero = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        full = (a["held"] != "") & (F.length(a["held"]) + F.length(s) > most)
        held = F.concat(F.when(full, "").otherwise(a["held"]), s, F.lit(" "))
        return F.struct(held.alias("held"), F.when(full, F.array_append(a["out"], F.trim(a["held"]))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(sentences, zero, step, lambda a: F.when(F.trim(a["held"]) != "", F.array_append(a["out"], F.trim(a["held"]))).otherwise(a["out"]))
    return F.coalesce(done, F.array().cast("array<string>"))


def bounded_udf(sentences: Column) -> Column:
    """bounded() a few rows at a time."""
    return _udf(lambda x: bounded(list(x)) if x is not None else [])(sentences)


def sliding_udf(text: Column) -> Column:
    return _udf(lambda x: sliding(x) if x else [])(text)


def with_dots_udf(sentences: Column) -> Column:
    return _udf(lambda x: with_dots(list(x)) if x is not None else [])(sentences)


def permutation(length: int, seed: int) -> list[int]:
    """A shuffle of 0 to length - 1 that a 64-bit seed decides: numbers of a xorshift generator choose the places from the last one on."""
    mask = (1 << 64) - 1
    state = seed & mask or 0xDEADBEEFCAFEBABE  # fixed value: what a seed of 0 stands for
    places = list(range(length))
    for last in range(length - 1, 0, -1):
        for left, by in ((True, 13), (False, 7), (True, 17)):  # fixed values: shifts of the generator
            state ^= (state << by if left else state >> by) & mask
        pick = state % (last + 1)
        places[last], places[pick] = places[pick], places[last]
    return places


def inverse(places: list[int]) -> list[int]:
    return sorted(range(len(places)), key=places.__getitem__)


def shuffled_udf(items: Column, seed: Column, back: bool = False) -> Column:
    """Items in the order of the permutation that a seed gives, or with back those so shuffled in their first order."""

    def run(items: pd.Series, seed: pd.Series) -> pd.Series:
        order = lambda n, s: inverse(permutation(n, s)) if back else permutation(n, s)
        return pd.Series([None if x is None else [x[i] for i in order(len(x), int(s))] for x, s in zip(items, seed, strict=True)])

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(items, seed)
