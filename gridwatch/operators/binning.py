"""Bins: equal frequency, equal width, given edges, probability bins, hexagons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import quantiles


def quantile_edges(df: DataFrame, column: str, n: int) -> list[float]:
    """Exact ``n`` + 1 quantiles, linear between order statistics; equal edges are an error."""
    edges = quantiles(df, {column: [i / n for i in range(n + 1)]})[column]
    if edges[0] is None:
        return []
    if len(set(edges)) < len(edges):
        raise ValueError(f"bin edges of {column} aren't distinct: {edges}")
    return edges


def into_bins(column: str, edges: list[float]) -> Column:
    """1 to n for ``(lo, hi]`` (the first also holds its lower edge), null outside."""
    out = F.lit(None).cast("int")
    c = F.col(column)
    for i in range(len(edges) - 1, 0, -1):
        low = c >= edges[0] if i == 1 else c > edges[i - 1]
        out = F.when(low & (c <= edges[i]), F.lit(i)).otherwise(out)
    return out


def equal_width(df: DataFrame, column: str, n: int) -> tuple[DataFrame, list[float]]:
    """``bin`` 1 to n of right-closed bins between minimum and maximum, the first edge lowered by 0.1 % of the range."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.withColumn("bin", F.lit(None).cast("int")), []
    if low == high:
        low, high = low - 0.001 * (abs(low) or 1), high + 0.001 * (abs(high) or 1)
    edges = [low + (high - low) * i / n for i in range(n)] + [high]
    edges[0] = low - 0.001 * (high - low)
    return df.withColumn("bin", into_bins(column, edges)), edges


def midpoint(low: float, high: float, digits: int = 3) -> float:
    """Middle of a bin as printed: ends to ``digits`` significant digits after the point."""
    return (round(low, digits) + round(high, digits)) / 2


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """``bin, n`` over ``[lo, hi)`` bins, the last one closed; values outside are dropped, empty bins are 0."""
    c = F.col(column)
    last = len(edges) - 2
    parts = [F.count_if((c >= edges[i]) & ((c < edges[i + 1]) if i < last else (c <= edges[i + 1]))).alias(str(i)) for i in range(last + 1)]
    one = df.agg(*parts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), F.col(str(i)).alias("n")) for i in range(last + 1)))).alias("x")).select("x.bin", "x.n")


def binned_mean(df: DataFrame, column: str, value: str, low: float, high: float, n: int) -> DataFrame:
    """``bin, n, mean, sd`` (population) of ``value`` in ``n`` right-open bins of ``column``; the maximum falls out."""
    c = F.col(column)
    at = F.floor((c - low) / ((high - low) / n)).cast("int")
    return df.where((c >= low) & (c < high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def probability_bins(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """``bin, n, mean_p, rate``: a calibration curve over uniform bins of [0, 1]; empty bins are left out."""
    at = F.least(F.floor(F.col(p) * n), F.lit(n - 1)).cast("int")
    return df.where(F.col(p).between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def hexbins(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], size: int = 60, least: int = 1) -> DataFrame:
    """``hx, hy, lattice, n`` of a hexagonal lattice: of the two interleaved grids the nearer centre takes the point."""
    x0, x1, y0, y1 = bounds
    ny = int(size / math.sqrt(3))
    sx, sy = (F.col(x) - x0) / ((x1 - x0) / size), (F.col(y) - y0) / ((y1 - y0) / ny)
    ax, ay, bx, by = F.floor(sx + 0.5), F.floor(sy + 0.5), F.floor(sx), F.floor(sy)
    da = (sx - ax) * (sx - ax) + 3 * (sy - ay) * (sy - ay)
    db = (sx - bx - 0.5) * (sx - bx - 0.5) + 3 * (sy - by - 0.5) * (sy - by - 0.5)
    near = da < db
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.when(near, ax).otherwise(bx).alias("hx"), F.when(near, ay).otherwise(by).alias("hy"), F.when(near, 0).otherwise(1).alias("lattice"))
    return cells.groupBy("hx", "hy", "lattice").agg(F.count("*").alias("n")).where(F.col("n") >= least)
