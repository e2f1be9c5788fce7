"""Joins on ranges through bins of fixed width, so that a row meets only what is near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(at: Column, width: float) -> Column:
    return F.floor(at / width).cast("long")


def _binned(rows: DataFrame, lo: Column, hi: Column, width: float, tag: str) -> DataFrame:
    """Rows once for each bin their range touches; an empty or unknown range touches none."""
    some = rows.select(F.struct("*").alias(tag), lo.alias(f"{tag}_lo"), hi.alias(f"{tag}_hi")).where(f"{tag}_lo <= {tag}_hi")
    return some.withColumn("bin", F.explode(F.sequence(_bin(F.col(f"{tag}_lo"), width), _bin(F.col(f"{tag}_hi"), width))))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], width: float) -> DataFrame:
    """Pairs (l, r) of rows, as structs, that agree in the columns `on` and whose ranges, both ends included, meet.

    A pair comes out once, in the first bin that both touch. width should be about the length of a usual range: a
    range takes as many rows as it touches bins.
    """
    a, b = _binned(left, *left_range, width, "l"), _binned(right, *right_range, width, "r")
    keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    same = a.withColumnRenamed("bin", "lbin").join(b.withColumnRenamed("bin", "rbin"), [F.col("lbin") == F.col("rbin"), *keys])
    first = F.greatest(_bin(F.col("l_lo"), width), _bin(F.col("r_lo"), width))
    return same.where((F.col("lbin") == first) & (F.col("l_lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("l_hi"))).select("l", "r")


def outside(points: DataFrame, ranges: DataFrame, on: list[str], at: Column, bounds: tuple[Column, Column], width: float) -> DataFrame:
    """Points that lie in no range of the same `on`, both ends included."""
    b = _binned(ranges, *bounds, width, "r")
    p = points.withColumn("_at", at).withColumn("_bin", _bin(at, width))
    keys = [p[c] == F.col(f"r.{c}") for c in on]
    return p.join(b, [F.col("_bin") == F.col("bin"), *keys, F.col("_at").between(F.col("r_lo"), F.col("r_hi"))], "left_anti").drop("_at", "_bin")
