"""Metrics of scored rows, exact at any size: rows are grouped by score first, and cumulative counts take two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .binning import probability_bins

BUCKETS = 4096


def score_table(df: DataFrame, score: str, y: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``score, pos, n`` for each distinct score of a group, with ``tp`` and ``seen``: positives and rows at or above it.

    Scores are dealt into ranges of a fixed grid between the smallest and the largest; a range's start comes from the
    sums of the ranges above it, so no group is sorted in one task.
    """
    flat = df.select(*group, F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y")).where("score is not null and y is not null")
    ties = flat.groupBy(*group, "score").agg(F.sum("y").cast("bigint").alias("pos"), F.count("*").alias("n"))
    ends = flat.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    range_ = F.coalesce(F.floor((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(0))
    dealt = ties.crossJoin(F.broadcast(ends)).withColumn("_r", range_).drop("_lo", "_hi")
    sums = dealt.groupBy(*group, "_r").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    above = W.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, "_r", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"))
    own = W.partitionBy(*group, "_r").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(starts, [*group, "_r"])
    return out.select(*group, "score", "pos", "n", (F.col("_p0") + F.sum("pos").over(own)).alias("tp"), (F.col("_n0") + F.sum("n").over(own)).alias("seen"))


def _totals(df: DataFrame, y: str, score: str, group: tuple[str, ...]) -> DataFrame:
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*group).agg(F.sum(F.col(y).cast("int")).cast("bigint").alias("_pos"), F.count("*").alias("_all"))


def _with_totals(t: DataFrame, totals: DataFrame, group: tuple[str, ...]) -> DataFrame:
    return t.join(totals, list(group)) if group else t.crossJoin(F.broadcast(totals))


def average_precision(df: DataFrame, score: str, y: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise area under precision and recall, tied scores together; null without positives."""
    t = _with_totals(score_table(df, score, y, group), _totals(df, y, score, group), group)
    part = F.col("pos") / F.col("_pos") * F.col("tp") / F.col("seen")
    return t.groupBy(*group).agg(F.sum(F.when(F.col("_pos") > 0, part)).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, y: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Probability that a positive outscores a negative, ties a half; null with one class only."""
    t = _with_totals(score_table(df, score, y, group), _totals(df, y, score, group), group)
    below = (F.col("_all") - F.col("_pos")) - (F.col("seen") - F.col("tp"))
    wins = F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)
    pairs = F.col("_pos") * (F.col("_all") - F.col("_pos"))
    return t.groupBy(*group).agg(F.sum(F.when(pairs > 0, wins / pairs)).alias("roc_auc"))


def brier(p: str, y: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def at_threshold(df: DataFrame, score: str, y: str, cut: float, group: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Counts of the four outcomes, precision, recall and F1 (0 where undefined)."""
    hit = F.col(score) > cut if strict else F.col(score) >= cut
    pos = F.col(y) == 1
    one = df.groupBy(*group).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = one.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return one.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def best_f1(df: DataFrame, score: str, y: str) -> DataFrame:
    """Threshold with the largest F1; ties: the largest threshold."""
    t = _with_totals(score_table(df, score, y), _totals(df, y, score, ()), ())
    p, r = F.col("tp") / F.col("seen"), F.col("tp") / F.col("_pos")
    t = t.where("_pos > 0").select(F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-8)).alias("f1"))
    return t.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", "threshold")).alias("s")).select("s.*")


def confusion(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """All four cells, empty ones as 0."""
    cells = F.array(*(F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.count_if((F.col(y) == a) & (F.col(predicted) == b)).alias("n")) for a in (0, 1) for b in (0, 1)))
    return df.agg(cells.alias("c")).select(F.explode("c").alias("s")).select("s.*")


def calibration_curve(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    return probability_bins(df, p, y, n)


def by_month(df: DataFrame, score: str, y: str, cut: float, month: Column) -> DataFrame:
    """Average precision (null without positives), actual and predicted rates by month."""
    m = df.withColumn("month", month)
    rates = m.groupBy("month").agg(F.avg(F.col(y).cast("double")).alias("actual_rate"), F.avg((F.col(score) >= cut).cast("double")).alias("predicted_rate"), F.count("*").alias("n"))
    return rates.join(average_precision(m, score, y, ("month",)), "month", "left")


def daily_evaluation(df: DataFrame, p: str, y: str, day: Column, cut: float = 0.3415, baseline: float = 0.0623, warn: float = 5.0) -> DataFrame:
    """Brier score, rates and counts by day, average precision where both classes are there, and the change against a baseline."""
    d = df.withColumn("day", day)
    one = d.groupBy("day").agg(brier(p, y).alias("brier"), F.avg(F.col(y).cast("double")).alias("actual_rate"), F.avg((F.col(p) > cut).cast("double")).alias("predicted_rate"), F.sum(y).cast("bigint").alias("n_spikes"), F.count("*").alias("n"))
    ap = average_precision(d, p, y, ("day",))
    out = one.join(ap, "day", "left").withColumn("average_precision", F.when((F.col("n_spikes") > 0) & (F.col("n_spikes") < F.col("n")), F.col("average_precision")))
    change = (F.col("brier") - baseline) / baseline * 100
    return out.withColumn("degradation_pct", change).withColumn("degraded", change > warn)


def brier_improvement(df: DataFrame, raw: str, calibrated: str, y: str) -> DataFrame:
    one = df.agg(brier(raw, y).alias("brier_raw"), brier(calibrated, y).alias("brier_calibrated"))
    return one.withColumn("improvement_pct", (F.col("brier_raw") - F.col("brier_calibrated")) / F.col("brier_raw") * 100)


def forecast_errors(df: DataFrame, actual: str, forecast: str, window: str | None = None) -> DataFrame:
    """MAE, RMSE, MAPE over non-zero actuals, bias, correlation and the number of windows."""
    e = F.col(forecast) - F.col(actual)
    a = F.col(actual)
    n = F.count_distinct(window) if window else F.lit(None).cast("bigint")
    return df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).agg(
        n.alias("window_count"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.when(a != 0, F.abs(e / a))) * 100).alias("mape"), F.avg(e).alias("bias"), F.corr(actual, forecast).alias("correlation")
    )


def compare_forecasts(ours: DataFrame, baseline: DataFrame, metrics: tuple[str, ...] = ("mae", "rmse", "mape", "bias")) -> DataFrame:
    """``metric, ours, baseline, winner``: the smaller absolute value wins; ties go to the baseline."""
    both = ours.select(*(F.col(m).alias(f"a_{m}") for m in metrics)).crossJoin(baseline.select(*(F.col(m).alias(f"b_{m}") for m in metrics)))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("ours"), F.col(f"b_{m}").alias("baseline")) for m in metrics))
    out = both.select(F.explode(rows).alias("s")).select("s.*")
    return out.withColumn("winner", F.when(F.abs("ours") < F.abs("baseline"), "ours").otherwise("baseline"))
