"""Population stability, robust scores and anomaly verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import quantiles


def long_form(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``feature, value`` rows without nulls, beside ``keys``."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*(keys or []), F.explode(cells).alias("s")).select(*(keys or []), "s.feature", "s.value").where("value is not null")


def psi(baseline: DataFrame, actual: DataFrame, columns: list[str], n_bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """``feature, psi`` over bins at the baseline's exact quantiles, all features at once.

    Bins are ``[lo, hi)``, the last one closed; shares are of all non-null values, so values outside lower them. A
    feature with an empty side or fewer than two distinct edges has 0.
    """
    columns = [c for c in columns if c in baseline.columns and c in actual.columns]
    spark = actual.sparkSession
    if not columns:
        return spark.createDataFrame([], "feature string, psi double")
    cut = quantiles(baseline, {c: [i / n_bins for i in range(n_bins + 1)] for c in columns})
    edges = {c: sorted({x for x in q if x is not None}) for c, q in cut.items()}

    def cell(c: str) -> Column:
        """The feature and the bin of its value: 0 and one past the last hold what is outside."""
        v = F.col(c).cast("double")
        bin_ = sum((F.when(v >= x, 1).otherwise(0) for x in edges[c]), F.lit(0))
        bin_ = F.when(v == edges[c][-1], len(edges[c]) - 1).otherwise(bin_) if edges[c] else bin_
        return F.struct(F.lit(c).alias("feature"), F.lit(len(edges[c])).alias("k"), F.when(v.isNotNull(), bin_).alias("bin"))

    sides = [df.select(F.lit(n).alias("side"), F.explode(F.array(*map(cell, columns))).alias("x")) for n, df in ((0, baseline), (1, actual))]
    # a row for each feature and bin, whatever the tables hold
    e, a = F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)
    bins = sides[0].unionByName(sides[1]).select("side", "x.*").groupBy("feature", "k", "bin").agg(e.alias("e"), a.alias("a"))
    known = F.filter(F.collect_list(F.struct("bin", "e", "a")), lambda x: x["bin"].isNotNull())
    every = bins.groupBy("feature", "k").agg(known.alias("bins"))
    total = lambda side: F.aggregate("bins", F.lit(0).cast("bigint"), lambda s, x: s + x[side])
    every = every.withColumns({"te": total("e"), "ta": total("a")})

    def term(x: Column) -> Column:
        # bins without any value add nothing: both shares are eps
        e, a = x["e"] / F.col("te") + eps, x["a"] / F.col("ta") + eps
        return F.when((x["bin"] >= 1) & (x["bin"] < F.col("k")), (a - e) * F.ln(a / e)).otherwise(0.0)

    summed = F.aggregate("bins", F.lit(0.0), lambda s, x: s + term(x))
    found = every.select("feature", F.when((F.col("te") > 0) & (F.col("ta") > 0), summed).otherwise(0.0).alias("psi"))
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(F.broadcast(found), "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def drift_status(scores: DataFrame, watch: float = 0.1, act: float = 0.2) -> DataFrame:
    return scores.withColumn("status", F.when(F.col("psi") > act, "drift").when(F.col("psi") > watch, "watch").otherwise("stable"))


def drift_decision(scores: DataFrame, act: float = 0.2) -> DataFrame:
    """The largest index, its feature, and whether it calls for training anew."""
    top = F.max_by("feature", F.struct("psi", "feature"))
    return scores.agg(F.max("psi").alias("max_psi"), top.alias("worst_feature"), F.count_if(F.col("psi") > act).alias("n_drifted")).withColumn("retrain", F.coalesce(F.col("max_psi") > act, F.lit(False)))


def robust_scaled(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns less their exact median, over their interquartile range (1 where that is 0)."""
    cut = quantiles(fit_on if fit_on is not None else df, dict.fromkeys(columns, [0.25, 0.5, 0.75]))
    scaled = {c: (F.col(c) - F.lit(q[1]).cast("double")) / F.lit(None if q[1] is None else (q[2] - q[0]) or 1.0).cast("double") for c, q in cut.items()}
    return df.withColumns(scaled)


def robust_z_top(df: DataFrame, columns: list[str], keys: list[str], n: int = 3, least_mad: float = 0.01, rows: DataFrame | None = None) -> DataFrame:
    """For each row of ``rows`` (default: all) the ``n`` features farthest from the median of ``df`` in median deviations."""
    med = {c: q[0] for c, q in quantiles(df, dict.fromkeys(columns, [0.5])).items()}
    far = {c: F.abs(F.col(c).cast("double") - F.lit(med[c]).cast("double")) for c in columns}
    dev = {c: q[0] for c, q in quantiles(df.select(*(far[c].alias(c) for c in columns)), dict.fromkeys(columns, [0.5])).items()}
    both = rows if rows is not None else df
    z = F.array(*(F.struct(F.lit(c).alias("feature"), (far[c] / F.lit(dev[c] if dev[c] is not None and dev[c] > least_mad else None).cast("double")).alias("z")) for c in columns))
    # features of one row, sorted within the row: largest z first, ties by name
    ranked = F.array_sort(F.filter(z, lambda s: s["z"].isNotNull()), lambda a, b: F.when(a["z"] > b["z"], -1).when(a["z"] < b["z"], 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    out = both.select(*keys, F.posexplode(F.slice(ranked, 1, n)).alias("place", "s"))
    return out.select(*keys, (F.col("place") + 1).alias("place"), "s.feature", "s.z")


def lowest(df: DataFrame, score: str, n: int = 5, then: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(F.col(score), *then).limit(n)


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    places = (1, 5, 50, 95)
    cut = quantiles(df, {score: [p / 100 for p in places]})[score]
    one = df.agg(F.count(score).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"))
    return one.select("n", "min", "max", "mean", *(F.lit(q).cast("double").alias(f"p{p}") for p, q in zip(places, cut, strict=True)))


def anomaly_verdict(rate: DataFrame, training_rate: float) -> DataFrame:
    """``rate`` has a column ``anomaly_rate``; over 2 times the training rate is high, over 1.5 times raised."""
    ratio = F.col("anomaly_rate") / training_rate
    return rate.withColumn("ratio", ratio).withColumn("verdict", F.when(ratio > 2, "high").when(ratio > 1.5, "raised").otherwise("normal"))
