"""Positional windows over the rows of a series: lags, differences, rolling statistics, islands.

Every function takes ``series`` (the columns that tell series apart, none for one) and runs on blocks with a halo
(``blocks.windowed``), never on one unpartitioned window.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import clip, flag
from .blocks import _haloed, indexed, running_sum, windowed


def shifted(df: DataFrame, column: str, lags: list[int], ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """``<column>_lag<k>`` for each k of ``lags`` (negative: ``_lead<k>``)."""
    low, high = max(0, -min(lags)), max(0, *lags)

    def add(w: WindowSpec) -> dict[str, Column]:
        return {f"{column}_lag{k}" if k >= 0 else f"{column}_lead{-k}": F.lag(column, k).over(w) if k >= 0 else F.lead(column, -k).over(w) for k in lags}

    if low:  # leads are lags of a block that looks ahead: reverse the order
        base = indexed(df, ts, series)
        ahead = base.withColumn("idx", -F.col("idx"))
        leads = windowed(ahead, lambda w: {f"{column}_lead{-k}": F.lag(column, -k).over(w) for k in lags if k < 0}, low, ts, series)
        leads = leads.withColumn("idx", -F.col("idx"))
        rest = [k for k in lags if k >= 0]
        return windowed(leads, lambda w: {f"{column}_lag{k}": F.lag(column, k).over(w) for k in rest}, max(high, 1), ts, series) if rest else leads
    return windowed(df, add, high, ts, series)


def difference(df: DataFrame, column: str, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """``<column>_diff``: a row's value less that of the row before."""
    return windowed(df, lambda w: {f"{column}_diff": F.col(column) - F.lag(column).over(w)}, 1, ts, series)


def rolling(df: DataFrame, column: str, kind: str, rows: int, to: str, least: int | None = None, current: bool = True, q: float = 0.5, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """Rolling ``mean``, ``std`` (sample), ``median`` or ``quantile`` of up to ``rows`` rows; null under ``least`` values."""
    least = rows if least is None else least
    if kind in ("median", "quantile") and rows > 128:
        return rolling_quantile(df, column, q, rows, to, least, current, ts, series)

    def add(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(1 - rows, 0) if current else w.rowsBetween(-rows, -1)
        value = {"mean": F.avg(column), "std": F.stddev_samp(column), "median": F.percentile(column, F.lit(q)), "quantile": F.percentile(column, F.lit(q))}[kind]
        return {to: F.when(F.count(column).over(frame) >= least, value.over(frame))}

    return windowed(df, add, rows, ts, series)


def rolling_quantile(df: DataFrame, column: str, q: float, rows: int, to: str, least: int, current: bool = False, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """Rolling quantile (linear between order statistics) of wide windows: a sliding kernel over blocks with a halo."""
    base = _haloed(indexed(df, ts, series), rows + 1, None)
    schema = df.select(*df.columns).withColumn("idx", F.lit(0).cast("bigint")).withColumn(to, F.lit(None).cast("double")).schema

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", kind="stable")
        values = part[column].astype(float)
        part[to] = (values if current else values.shift(1)).rolling(rows, min_periods=least).quantile(q)
        return part[part["_own"]][schema.names]

    return base.groupBy(*series, "_blk").applyInPandas(kernel, schema)


def price_features(df: DataFrame, price: str = "price", lags: tuple[int, ...] = (1, 4, 96), ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """Rolling median and deviation over 96 rows (current row included, 48 at least, deviation 1 at least), a 0.9
    quantile threshold over 2880 rows before (96 at least, 50 at least), z-scores and threshold ratios of lags (2 at most)."""
    out = rolling_quantile(df, price, 0.9, 2880, "threshold", 96, False, ts, series)
    out = out.withColumn("threshold", clip("threshold", low=50.0))
    out = windowed(
        out,
        lambda w: {
            "median96": F.when(F.count(price).over(w.rowsBetween(-95, 0)) >= 48, F.percentile(price, F.lit(0.5)).over(w.rowsBetween(-95, 0))),
            "std96": F.when(F.count(price).over(w.rowsBetween(-95, 0)) >= 48, F.stddev_samp(price).over(w.rowsBetween(-95, 0))),
            **{f"{price}_lag{k}": F.lag(price, k).over(w) for k in lags},
        },
        max(96, *lags),
        ts,
        series,
    )
    out = out.withColumn("std96", clip("std96", low=1.0))
    return out.withColumns(
        {f"{price}_delta_lag{k}": (F.col(f"{price}_lag{k}") - F.col("median96")) / F.col("std96") for k in lags}
        | {f"{price}_vs_threshold_lag{k}": clip(F.col(f"{price}_lag{k}") / F.col("threshold"), high=2.0) for k in lags}
        | {f"{price}_above_lag{k}": flag(F.col(f"{price}_lag{k}") > F.col("threshold")) for k in lags}
    )


def islands(df: DataFrame, gap: str = "30 minutes", to: str = "island", ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """Numbers runs of rows whose neighbours are no more than ``gap`` apart, from 0."""
    marked = windowed(df, lambda w: {"_prev": F.lag(ts).over(w)}, 1, ts, series)
    fresh = F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") > F.expr(f"interval {gap}"))
    return running_sum(marked, fresh.cast("int"), to, ts, series, then=("idx",)).withColumn(to, F.col(to) - 1).drop("_prev", "idx")


def duplicates(df: DataFrame, by: list[str]) -> DataFrame:
    """Keys that come more than once, and how many rows of each are repeats."""
    return df.groupBy(*by).agg((F.count("*") - 1).alias("n_repeats")).where("n_repeats > 0")


def backward_steps(df: DataFrame, ts: str = "ts", seq: str = "seq", block: int = 1 << 20) -> DataFrame:
    """Rows, in order of arrival, whose time is before that of the row before. ``seq`` numbers the rows from 0 or so."""
    b = df.select(F.col(seq).alias("idx"), ts)
    return windowed(b, lambda w: {"prev": F.lag(ts).over(w)}, 1, ts, (), block).where(F.col(ts) < F.col("prev"))


def lag_matrix(df: DataFrame, columns: list[str], k: int, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """Lags 1 to ``k`` of each column, for regressions."""
    return windowed(df, lambda w: {f"{c}_{j}": F.lag(c, j).over(w) for c in columns for j in range(1, k + 1)}, k, ts, series)


