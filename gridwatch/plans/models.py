"""Queries of trained and iterative operators; SQL can't express them, so the tests hold them against known results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, backtest, boosting, cluster, iforest, metrics, stats, training, tree_attribution
from . import panel as pn
from .catalogue import query

FEATURES = ["unplanned", "abs_unplanned", "sched", "upstream_error", "hour", "minute"]
#: Rows that the attributions' rows are compared with; every row with known features is explained.
BACKGROUND = 5000


def granger_tests(spark, d):
    hourly = pn.features(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(*(F.avg(c).alias(c) for c in ("upstream_error", "unplanned", "price")))
    links = (("error to price", "price", "upstream_error"), ("error to flow", "unplanned", "upstream_error"), ("flow to price", "price", "unplanned"))
    out = [stats.granger(hourly, y, x, 4, name) for name, y, x in links]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def granger(spark, d):
    return granger_tests(spark, d)


@query()
def granger_go(spark, d):
    """Go or no-go: whether any lag of the link from the upstream error to the price is significant."""
    return stats.any_significant(granger_tests(spark, d), "error to price")


@query()
def ols_p_values(spark, d):
    return stats.ols_with_p(pn.features(spark, d), [("unplanned", "price"), ("upstream_error", "unplanned")])


@query()
def iforest_scores(spark, d):
    t = pn.features(spark, d).withColumn("key", F.unix_micros(F.col("ts").cast("timestamp")))
    cols = ["price", "unplanned", "sched", "upstream_error"]
    return iforest.flagged(iforest.score(t, iforest.grow(t, cols, "key"), cols)).select("ts", "anomaly_score", "is_anomaly")


def _fitted(spark, d):
    t = pn.labelled(spark, d).select("ts", "price", "price_spike", *FEATURES)
    train, later = training.fraction_split(t, 0.8)
    fit, hold = training.fraction_split(train, 0.8)
    learnt, _ = training.fraction_split(fit, 0.8)
    cut = learnt.count()
    model = training.fit_boosted(fit.withColumn("held", F.col("idx") >= cut), FEATURES, "price_spike", held="held")
    return model, training.fit_calibration(training.raw_scores(model, hold), "price_spike"), later, fit


@query()
def gbt_scores(spark, d):
    model, calibration, later, _ = _fitted(spark, d)
    return training.predictions(model, calibration, later).select("ts", "price", "price_spike", "prob_raw", "prob_calibrated", "spike_predicted")


@query()
def attributions(spark, d):
    model, _, later, fit = _fitted(spark, d)
    known = later.dropna(subset=FEATURES)
    background = fit.dropna(subset=FEATURES).orderBy(F.xxhash64("idx"), "idx").limit(BACKGROUND)
    found = attribution.attributions(lambda x: training.raw_scores(model, x), known, background, FEATURES, "idx")
    return attribution.mean_absolute(found)


_FORESTS: dict[tuple[str, str], boosting.Forest] = {}


def _monotone(spark, d):
    """Trees whose spike probability rises with the unplanned flow, fitted once for each source and session, and the later rows."""
    t = pn.labelled(spark, d).select("ts", "price_spike", *FEATURES)
    train, later = training.fraction_split(t, 0.8)
    key = (spark.sparkContext.applicationId, d)
    if key not in _FORESTS:
        cut = int(0.8 * train.count())
        rising = {"unplanned": 1, "abs_unplanned": 1}
        _FORESTS[key] = boosting.fit_forest(train.withColumn("held", F.col("idx") >= cut), FEATURES, "price_spike", rising, held="held", rounds=10, rate=0.3)
    return _FORESTS[key], later


@query()
def monotone_scores(spark, d):
    forest, later = _monotone(spark, d)
    return forest.scores(later).select("ts", "price_spike", "prob_raw")


@query()
def tree_attributions(spark, d):
    """Exact attributions of every later row, their mean by feature."""
    return attribution.mean_absolute(tree_attribution.tree_attributions(*_monotone(spark, d), "idx"))


@query()
def tree_interactions(spark, d):
    """Mean absolute interaction of every two features over the later rows."""
    found = tree_attribution.tree_interactions(*_monotone(spark, d), "idx")
    return found.groupBy("feature", "other").agg(F.avg(F.abs("interaction")).alias("mean_abs"))


@query()
def vector_clusters(spark, d):
    v = pn.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return cluster.density_clusters(cluster.reduced(v, "v", 10), "vec_id", "v", eps=0.35, min_samples=3, min_size=4)


@query()
def backtest_metrics(spark, d):
    b = backtest.backtest(pn.features(spark, d), "price", "2024-01-15")
    return metrics.forecast_errors(b, "actual", "forecast", "day")
