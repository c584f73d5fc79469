"""Rolling-origin backtest of a seasonal regression, from running sums of daily products.

Each day gives one small matrix of products; the sums over all days before an origin are a scan of those
matrices, so every fit costs a solve and no history is read twice.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAILY, WEEKLY = 4, 2


def _terms(ts: str, origin: str) -> list[Column]:
    """Trend, daily and weekly Fourier terms of a time."""
    days = (F.unix_micros(F.col(ts).cast("timestamp")) / 86_400e6) - (F.unix_micros(F.lit(origin).cast("timestamp")) / 86_400e6)
    out = [F.lit(1.0), days / 365.25]
    for period, orders in ((1.0, DAILY), (7.0, WEEKLY)):
        for k in range(1, orders + 1):
            out += [F.sin(2 * math.pi * k * days / period), F.cos(2 * math.pi * k * days / period)]
    return out


def backtest(df: DataFrame, value: str, first_day: str, ts: str = "ts", steps: int = 96, least: float = 0.8, origin: str = "2020-01-01", ridge: float = 1e-3) -> DataFrame:
    """``day, ts, actual, forecast`` for each day from ``first_day`` on with at least ``least`` of ``steps`` actuals, fitted on all rows before it."""
    x = _terms(ts, origin)
    k = len(x)
    rows = df.where(F.col(value).isNotNull()).select(F.to_date(ts).alias("day"), ts, F.col(value).cast("double").alias("actual"), F.array(*x).alias("x"))
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(k) for j in range(i, k)] + [F.sum(F.col("x")[i] * F.col("actual")) for i in range(k)]
    daily = rows.groupBy("day").agg(F.array(*products).alias("p"), F.count("*").alias("n"))
    m = len(products)
    # a row for each day: the scan runs over them in order
    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    sums = daily.select("day", "n", F.array(*(F.sum(F.col("p")[i]).over(before) for i in range(m))).alias("p"))
    origins = sums.where((F.col("day") >= F.lit(first_day).cast("date")) & (F.col("n") >= least * steps) & F.col("p")[0].isNotNull())

    def solve(batches):
        upper = np.triu_indices(k)
        for b in batches:
            out = []
            for p in b["p"]:
                g = np.zeros((k, k))
                g[upper] = p[: m - k]
                g = g + np.triu(g, 1).T + ridge * np.eye(k)
                out.append(np.linalg.solve(g, np.asarray(p[m - k :])))
            yield pd.DataFrame({"day": b["day"], "beta": out})

    fitted = origins.select("day", "p").mapInPandas(solve, "day date, beta array<double>")
    joined = rows.join(fitted, "day")
    forecast = reduce(lambda a, b: a + b, (F.col("x")[i] * F.col("beta")[i] for i in range(k)))
    return joined.select("day", ts, "actual", forecast.alias("forecast"))
