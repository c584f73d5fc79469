"""Correlation, regression and Granger tests; only sums of products reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_tail, pearson_p
from .binning import into_bins, quantile_edges
from .scratch import kept
from .windows import lag_matrix, shifted


def ols(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``feature_x, target_y, pearson_r, r_squared, slope, intercept, n_obs`` of each pair's complete rows, in one pass."""
    parts = []
    for x, y in pairs:
        a, b = F.col(x).cast("double"), F.col(y).cast("double")
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        parts.append(F.struct(F.lit(x).alias("feature_x"), F.lit(y).alias("target_y"), F.corr(a, b).alias("pearson_r"), F.regr_r2(b, a).alias("r_squared"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.count(a).alias("n_obs")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def ols_with_p(df: DataFrame, pairs: list[tuple[str, str]], rounded: bool = False) -> DataFrame:
    """``ols`` and the two-sided p-value of each correlation."""
    rows = [r.asDict() | {"pearson_p": pearson_p(r["pearson_r"], r["n_obs"])} for r in ols(df, pairs).collect()]  # a row for each pair
    if rounded:
        rows = [{k: round(v, 6 if k == "pearson_p" else 4) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
    return df.sparkSession.createDataFrame(rows, "feature_x string, target_y string, pearson_r double, pearson_p double, r_squared double, slope double, intercept double, n_obs bigint")


def cross_correlation(df: DataFrame, x: str, y: str, max_lag: int = 12, minutes: int = 15, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """``lag_intervals, lag_minutes, pearson_r`` for each lag; positive: x leads y. One window, one aggregation."""
    wide = shifted(df.select(*series, ts, x, y), y, [k for k in range(-max_lag, max_lag + 1) if k], ts, series)
    name = lambda k: y if k == 0 else (f"{y}_lead{k}" if k > 0 else f"{y}_lag{-k}")
    parts = [F.struct(F.lit(k).alias("lag_intervals"), F.lit(k * minutes).alias("lag_minutes"), F.corr(x, name(k)).alias("pearson_r")) for k in range(-max_lag, max_lag + 1)]
    return wide.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def strongest(correlations: DataFrame) -> DataFrame:
    """The row with the largest absolute correlation; ties: the first lag."""
    best = F.max_by(F.struct("lag_intervals", "lag_minutes", "pearson_r"), F.struct(F.abs("pearson_r"), -F.col("lag_intervals")))
    return correlations.where("pearson_r is not null").agg(best.alias("s")).select("s.*")


def granger(df: DataFrame, y: str, x: str, max_lag: int = 4, link: str = "", ts: str = "ts", series: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """F-tests of whether lags of ``x`` help to predict ``y`` beyond its own: a row for each lag order.

    The lags are columns of one window; each order takes one aggregation of centred products, and a solve of at
    most ``2 * max_lag`` unknowns. A row of nulls stands where there are too few rows or no residual is left.
    """
    base = kept(lag_matrix(df.select(*series, ts, x, y).dropna(), [x, y], max_lag, ts, series), "lags")  # each order reads it twice
    out = []
    for k in range(1, max_lag + 1):
        own, other = [f"{y}_{j}" for j in range(1, k + 1)], [f"{x}_{j}" for j in range(1, k + 1)]
        names = [y, *own, *other]
        rows = base.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
        mean = rows.agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("_n")).first()
        n = mean["_n"]
        line = {"causal_link": link, "lag": k, "F_stat": None, "p_value": None, "df1": k, "df2": n - 2 * k - 1, "significant": False}
        if n > 2 * k + 1:
            c = {a: F.col(a) - F.lit(mean[a]) for a in names}
            sums = rows.agg(*(F.sum(c[a] * c[b]).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
            gram = np.array([[sums[f"s_{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
            rss = [_residual(gram, m) for m in (k, 2 * k)]
            if rss[1] > 0:
                f = ((rss[0] - rss[1]) / k) / (rss[1] / (n - 2 * k - 1))
                p = f_tail(f, k, n - 2 * k - 1)
                line |= {"F_stat": float(f), "p_value": p, "significant": bool(p < alpha)}
        out.append(line)
    return df.sparkSession.createDataFrame(out, "causal_link string, lag int, F_stat double, p_value double, df1 int, df2 bigint, significant boolean")


def _residual(gram: np.ndarray, m: int) -> float:
    """Residual sum of squares of the first variable on the next ``m``, all centred."""
    a, b = gram[1 : m + 1, 1 : m + 1], gram[1 : m + 1, 0]
    return float(gram[0, 0] - b @ np.linalg.lstsq(a, b, rcond=None)[0])


def any_significant(tests: DataFrame, link: str, alpha: float = 0.05) -> DataFrame:
    """Go or no-go: whether the smallest p-value of a link is under ``alpha``."""
    return tests.where(F.col("causal_link") == link).agg(F.min("p_value").alias("min_p")).withColumn("go", F.coalesce(F.col("min_p") < alpha, F.lit(False)))


def lift_by_quantile(df: DataFrame, column: str, flag: str, price: str, n: int = 5) -> DataFrame:
    """Probability of ``flag`` by equal-frequency bin of ``column``, and each bin's ratio to the first."""
    edges = quantile_edges(df, column, n)
    binned = df.withColumn("bucket", into_bins(column, edges)).where("bucket is not null")
    out = binned.groupBy("bucket").agg(F.avg(flag).alias("spike_probability"), F.count("*").alias("n"), F.avg(column).alias("avg_flow"), F.avg(price).alias("avg_price"))
    first = out.where("bucket = 1").select(F.col("spike_probability").alias("_first"))
    return out.crossJoin(F.broadcast(first)).withColumn("ratio_vs_q1", F.when(F.col("_first") != 0, F.col("spike_probability") / F.col("_first"))).drop("_first")


def price_by_minute(df: DataFrame, price: str, flag: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.minute(ts).cast("int").alias("minute")).agg(F.avg(price).alias("mean_price"), F.stddev_samp(price).alias("std_price"), F.avg(flag).alias("spike_rate"), F.count("*").alias("n"))


def slope_per_unit(lift: DataFrame, unit: float = 1000.0) -> DataFrame:
    """Rise of the probability from the first to the last bin, for each ``unit`` of the bins' mean."""
    first, last = (F.struct("spike_probability", "avg_flow") for _ in range(2))
    one = lift.agg(F.min_by(first, "bucket").alias("a"), F.max_by(last, "bucket").alias("z"))
    d = (F.col("z.avg_flow") - F.col("a.avg_flow")) / unit
    return one.select((F.col("z.spike_probability") - F.col("a.spike_probability")).alias("rise"), F.when(d != 0, (F.col("z.spike_probability") - F.col("a.spike_probability")) / d).alias("slope"))


def summary(regressions: DataFrame, lift: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row: the first regression's correlation, the lift of the last bin, and the strongest lag."""
    r = regressions.limit(1).select("pearson_r", "slope", "n_obs")
    up = lift.agg(F.max_by("ratio_vs_q1", "bucket").alias("lift"))
    lag = strongest(correlations).select("lag_minutes", F.col("pearson_r").alias("lag_r"))
    return r.crossJoin(up).crossJoin(lag)
