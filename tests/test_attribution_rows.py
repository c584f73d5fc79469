"""The registered attributions explain every row, and the trees are chosen on rows that they don't learn from."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from gridwatch.operators import attribution, training
from gridwatch.plans import models

T0 = dt.datetime(2024, 1, 1)


def test_every_row_is_explained(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, *(float(v) for v in rng.normal(size=len(models.FEATURES)))) for i in range(700)]
    df = spark.createDataFrame(rows, "idx long, " + ", ".join(f"{f} double" for f in models.FEATURES))
    asked, found = {}, attribution.attributions

    def watched(score, explained, background, *rest):
        asked.update(rows=explained.count(), background=background.count())
        return found(score, explained, background, *rest)

    monkeypatch.setattr(models, "_fitted", lambda *_: (None, None, df.where("idx >= 400"), df.where("idx < 400")))
    monkeypatch.setattr(training, "raw_scores", lambda _, x: x.withColumn("prob_raw", 2 * F.col("hour") + F.col("sched")))
    monkeypatch.setattr(attribution, "attributions", watched)
    assert [r.feature for r in models.attributions(spark, "").limit(2).collect()] == ["hour", "sched"]
    assert asked == {"rows": 300, "background": 400}


def test_registered_fit_uses_default_rounds_and_held_rows(spark, monkeypatch):
    names = ["price", *models.FEATURES]
    rows = [(T0 + dt.timedelta(minutes=15 * i), i % 2, *([float(i)] * len(names))) for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, price_spike int, " + ", ".join(f"{c} double" for c in names))
    seen = {}

    def fit(x, features, label, held=None, **options):
        seen.update(options, learnt=x.where(~F.col(held)).count(), held=x.where(held).count())

    monkeypatch.setattr(models.pn, "labelled", lambda *_: df)
    monkeypatch.setattr(training, "fit_boosted", fit)
    monkeypatch.setattr(training, "raw_scores", lambda _, x: x)
    monkeypatch.setattr(training, "fit_calibration", lambda x, _: x.count())
    assert models._fitted(spark, "")[1] == 16 and seen == {"learnt": 51, "held": 13}


def test_trees_up_to_the_least_held_loss(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), int(rng.random() < 0.5), bool(i >= 300)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y int, held boolean")
    model = training.fit_boosted(df, ["a", "b"], "y", held="held", rounds=12, rate=0.5)
    whole = training.fit_boosted(df.where("not held"), ["a", "b"], "y", rounds=12, rate=0.5)
    losses = whole.stages[-1].evaluateEachIteration(whole.stages[0].transform(df.where("held").withColumn("_w", F.when(F.col("y") == 1, 9.0).otherwise(1.0))))
    assert model.stages[-1].getNumTrees == losses.index(min(losses)) + 1 < 12
    assert training.raw_scores(model, df).where("prob_raw between 0 and 1").count() == 400
