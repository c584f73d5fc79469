"""Positional semantics against pandas, edge cases of the grid, and block invariance."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwatch.functions.columns import clip, conform, energy_to_power, flag, no_nan, sum_available
from gridwatch.functions.special import f_tail, incomplete_beta, pearson_p
from gridwatch.operators import binning, blocks, drift, events, metrics, quality, stats, timegrid, windows
from gridwatch.operators.quality import Field, Rule

T0 = dt.datetime(2024, 3, 1)


def slots(n, step=15):
    return [T0 + dt.timedelta(minutes=step * i) for i in range(n)]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(60, 20, 700)
    x[rng.random(700) < 0.1] = np.nan
    pdf = pd.DataFrame({"ts": slots(700), "x": x, "y": rng.normal(size=700)})
    df = spark.createDataFrame([(t.to_pydatetime(), None if math.isnan(a) else a, b) for t, a, b in pdf.itertuples(index=False)], "ts timestamp_ntz, x double, y double").repartition(5)
    return df, pdf


def same(got, want):
    np.testing.assert_allclose(np.array(got, dtype=float), np.array(want, dtype=float), rtol=1e-9, atol=1e-9)


def test_blocks_equal_one_window(series):
    df, pdf = series
    want = pdf["x"].shift(3)
    for block in (16, 100, 5000):
        got = blocks.windowed(df, lambda w: {"l": F.lag("x", 3).over(w)}, 3, block=block).orderBy("ts").toPandas()
        assert len(got) == len(pdf)
        same(got["l"], want)


def test_rolling(series):
    df, pdf = series
    x = pdf["x"]
    cases = [("mean", 4, None, False, x.shift(1).rolling(4).mean()), ("std", 96, 48, True, x.rolling(96, min_periods=48).std()), ("median", 96, 48, True, x.rolling(96, min_periods=48).median())]
    for kind, rows, least, current, want in cases:
        same(windows.rolling(df, "x", kind, rows, "r", least, current).orderBy("ts").toPandas()["r"], want)
    same(windows.rolling_quantile(df, "x", 0.9, 200, "r", 96).orderBy("ts").toPandas()["r"], x.shift(1).rolling(200, min_periods=96).quantile(0.9))


def test_fill_and_shift(series):
    df, pdf = series
    same(blocks.filled_forward(df, ["x"]).orderBy("ts").toPandas()["x"], pdf["x"].ffill())
    once = blocks.filled_forward(df, ["x"])
    same(blocks.filled_forward(once, ["x"]).orderBy("ts").toPandas()["x"], pdf["x"].ffill())
    got = windows.shifted(df, "y", [2, -3]).orderBy("ts").toPandas()
    same(got["y_lag2"], pdf["y"].shift(2))
    same(got["y_lead3"], pdf["y"].shift(-3))
    total = blocks.running_sum(df, F.col("y"), "s").orderBy("ts").toPandas()["s"]
    same(total, pdf["y"].cumsum())


def test_as_of_keeps_null_values(spark):
    left = spark.createDataFrame([(t,) for t in slots(6)], "ts timestamp_ntz")
    right = spark.createDataFrame([(T0 - dt.timedelta(days=2), 1.0), (T0 + dt.timedelta(minutes=20), None), (T0 + dt.timedelta(minutes=45), 3.0)], "ts timestamp_ntz, v double")
    assert [r.v for r in timegrid.as_of(left, right, ["v"]).orderBy("ts").collect()] == [1.0, 1.0, None, 3.0, 3.0, 3.0]


def test_local_time_and_repeats(spark):
    utc = spark.createDataFrame([(dt.datetime(2024, 10, 27, 0, 30), 1), (dt.datetime(2024, 10, 27, 1, 30), 2), (dt.datetime(2024, 3, 31, 0, 59), 3), (dt.datetime(2024, 3, 31, 1, 0), 4)], "ts timestamp_ntz, k int")
    local = timegrid.to_local(utc.withColumn("utc", F.col("ts")), "Europe/Zurich")
    assert [r.ts.hour for r in local.orderBy("k").collect()] == [2, 2, 1, 3]
    assert sorted(r.k for r in timegrid.first_of_each(local, "ts", ["utc"]).collect()) == [1, 3, 4]


def test_islands_at_the_gap(spark):
    ts = [0, 15, 45, 76, 200]
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), 1, float(m)) for m in ts], "ts timestamp_ntz, hit int, p double")
    got = events.episodes(df, "hit", "p", []).orderBy("event_id").collect()
    assert [(r.n_intervals, r.duration_min, r.peak_price) for r in got] == [(3, 60, 45.0), (1, 15, 76.0), (1, 15, 200.0)]


def test_continuity_thresholds(spark):
    def run(rows):
        return quality.time_continuity(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "seq long, ts timestamp_ntz")).first()

    full = slots(200)
    assert run([t for i, t in enumerate(full) if i not in (5, 9, 50, 51)]).severity == "ok"
    assert run([t for i, t in enumerate(full) if i not in (5, 9, 50, 51, 70)]).n_issues == 5
    assert run(full + [full[-1]] * 40).severity == "ok" and run(full + [full[-1]] * 41).n_issues == 41
    assert run([full[1], full[0], *full[2:]]).n_backwards == 1


def test_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (9.0, 2.0, 3.0)], "a double, b double, c double")
    r = df.select(clip("a", 2, 5).alias("a"), clip("b", 3).alias("b"), no_nan("c").alias("c"), flag(F.col("b") > 1).alias("f"), sum_available(df, ["a", "b", "zz"]).alias("s")).collect()
    assert [tuple(x) for x in r] == [(2.0, None, None, 0, 1.0), (5.0, 3.0, 3.0, 1, 11.0)]
    assert energy_to_power(spark.createDataFrame([(1000.0,)], "p_kwh double")).first().p_mw == 4.0
    assert conform(df, [("zz", "double"), ("a", "double")]).columns == ["zz", "a"]


def test_bins(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    edges = binning.quantile_edges(df, "x", 5)
    got = [r.b for r in df.select("x", binning.into_bins("x", edges).alias("b")).orderBy("x").collect()]
    assert got == (pd.qcut(pd.Series(x), 5, labels=False) + 1).tolist()
    with pytest.raises(ValueError):
        binning.quantile_edges(spark.createDataFrame([(1.0,)] * 5, "x double"), "x", 5)
    t, _ = binning.equal_width(df, "x", 4)
    assert [r.bin for r in t.orderBy("x").collect()] == (pd.cut(pd.Series(x), 4, labels=False) + 1).tolist()
    assert [r.n for r in binning.histogram(df, "x", [1, 4, 9]).orderBy("bin").collect()] == np.histogram(x, [1, 4, 9])[0].tolist()


def test_rules(spark):
    df = spark.createDataFrame([(1.0, -1.0, 0.5), (99.0, 2.0, None), (5.0, None, 1.0)], "a double, b double, c double")
    rules = [Rule("g", "range", "a", 0, 50), Rule("g", "non_negative", "b"), Rule("g", "non_positive", "b"), Rule("h", "not_simultaneous", "a", other="b"), Rule("g", "derived_field", "a", formula="b + c", tolerance=0.1), Rule("g", "derived_field", "a", formula="b +* c"), Rule("g", "odd", "a"), Rule("g", "range", "zz", 0, 1)]
    got = {r.rule_id: r.n_violations for r in quality.violations(df, rules).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    assert {r.rule_id for r in quality.violations(df, rules, ["h"]).collect()} == {3}
    assert len(quality.panel_rules()) == 32
    with pytest.raises(ValueError):
        quality.require_schema(df, [Field("a", high=50)])
    assert quality.require_schema(df, [Field("a")]) is df


def test_psi(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=800), rng.normal(0.4, 1.3, 700)
    base, now = (spark.createDataFrame([(float(v), 1.0) for v in x], "x double, k double") for x in (a, b))
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    e, n = np.histogram(a, edges)[0] / len(a) + 1e-6, np.histogram(b, edges)[0] / len(b) + 1e-6
    got = {r.feature: r.psi for r in drift.psi(base, now, ["x", "k", "absent"]).collect()}
    assert got["x"] == pytest.approx(float(((n - e) * np.log(n / e)).sum())) and got["k"] == 0 and set(got) == {"x", "k"}
    assert drift.psi(base, base, ["x"]).first().psi == pytest.approx(0, abs=1e-12)


def test_metrics(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p double, y int")
    ap, seen, tp, pos = 0.0, 0, 0, sum(y for _, y in rows)
    for s in sorted({p for p, _ in rows}, reverse=True):
        hit = [y for p, y in rows if p == s]
        seen, tp = seen + len(hit), tp + sum(hit)
        ap += sum(hit) / pos * tp / seen
    wins = sum((a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z)
    assert metrics.average_precision(df, "p", "y").first()[0] == pytest.approx(ap)
    assert metrics.roc_auc(df, "p", "y").first()[0] == pytest.approx(wins / (pos * (300 - pos)))
    assert metrics.average_precision(df.where("y = 0"), "p", "y").first()[0] is None
    assert metrics.at_threshold(df.where("y = 0"), "p", "y", 2.0).first().precision == 0


def test_granger(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = np.zeros(400)
    for t in range(2, 400):
        y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 2] + rng.normal() * 0.5
    df = spark.createDataFrame([(t, float(a), float(b)) for t, a, b in zip(slots(400, 60), x, y, strict=True)], "ts timestamp_ntz, x double, y double")
    got = {r.lag: r for r in stats.granger(df, "y", "x", 3).collect()}

    def rss(cols, k):
        m = np.column_stack([np.ones(400 - k), *cols])
        return float(((y[k:] - m @ np.linalg.lstsq(m, y[k:], rcond=None)[0]) ** 2).sum())

    for k in (1, 2, 3):
        own, other = [y[k - j : 400 - j] for j in range(1, k + 1)], [x[k - j : 400 - j] for j in range(1, k + 1)]
        a, b = rss(own, k), rss(own + other, k)
        df2 = 400 - k - 2 * k - 1
        assert got[k].F_stat == pytest.approx((a - b) / k / (b / df2), rel=1e-6) and got[k].df2 == df2
    assert got[2].p_value < 1e-10 and got[2].significant
    assert stats.granger(df.limit(3), "y", "x", 2).first().F_stat is None


def test_special_functions():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert f_tail(4.0, 2, 10) == pytest.approx((1 + 2 * 4.0 / 10) ** -5)
    assert pearson_p(0.5, 20) == pytest.approx(0.0247, abs=1e-4) and pearson_p(1.0, 20) == 0 and pearson_p(None, 3) is None
