"""Planted structure is found by the trained and iterative operators; streams agree with batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwatch.operators import attribution, backtest, cluster, events, iforest, registry, training
from gridwatch.operators.quality import Rule
from gridwatch.sources import files
from gridwatch.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_isolation_forest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(1500, 2)))] + [(9000 + i, 9.0 + i, -9.0) for i in range(5)] + [(9999, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double").repartition(4)
    forest = iforest.grow(df, ["a", "b"], "k", trees=40, rows=128)
    scored = iforest.flagged(iforest.score(df, forest, ["a", "b"], 128))
    worst = [r.k for r in scored.orderBy("anomaly_score").limit(5).collect()]
    assert set(worst) == {9000 + i for i in range(5)} and scored.count() == 1505
    assert 0.02 < scored.agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0] < 0.08


def test_boosted_trees_and_attribution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    rows = [(i, T0 + dt.timedelta(minutes=15 * i), float(a), float(b), float(c), int(a > 0.5)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, a double, b double, c double, y int")
    train, later = training.fraction_split(df, 0.8)
    assert (train.count(), later.count()) == (720, 180)
    assert [(a.count(), b.count()) for a, b in training.expanding_folds(df, 5)] == [(150 * (i + 1), 150) for i in range(5)]
    model = training.fit_boosted(train, ["a", "b", "c"], "y", rounds=5)
    out = training.predictions(model, training.fit_calibration(training.raw_scores(model, train), "y"), later)
    assert out.where("spike_predicted = y").count() > 170
    assert training.importance(model, ["a", "b", "c"]).first().feature == "a"
    found = attribution.attributions(lambda d: training.raw_scores(model, d), later.limit(40), train.limit(20), ["a", "b", "c"], "k").cache()
    assert attribution.mean_absolute(found).first().feature == "a"
    assert attribution.step_up(found, "a", 0.5).first().confirmed and attribution.bias_ratio(found, ["a"], ["b", "c"]).first().passes


def test_clusters(spark):
    rng = np.random.default_rng(3)
    centre = np.array([[0, 0, 0], [5, 0, 0], [0, 5, 5]])
    rows = [(i, [float(v) for v in centre[i % 3] + rng.normal(size=3) * 0.2], i % 3) for i in range(90)] + [(500 + i, [50.0 + 9 * i, 0.0, 0.0], -1) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, v array<double>, want long")
    got = cluster.density_clusters(df, "k", "v", eps=0.8, min_samples=4, min_size=10)
    pairs = {(r.want, r.cluster) for r in got.join(df, "k").collect()}
    assert pairs == {(0, 0), (1, 1), (2, 2), (-1, -1)}
    s = cluster.silhouette(got.join(df, "k"), "k", "v", "cluster").first()
    assert s.silhouette > 0.85 and (s.n_points, s.n_clusters) == (90, 3)
    assert cluster.reduced(df, "v", 2).first().v.__len__() == 2
    assert events.compare_clusterings({"m": got}).first().n_noise == 3


def test_backtest(spark):
    t = [T0 + dt.timedelta(minutes=15 * i) for i in range(96 * 30)]
    y = [50 + 10 * np.sin(2 * np.pi * i / 96) + 3 * np.cos(2 * np.pi * i / 672) for i in range(len(t))]
    df = spark.createDataFrame([(a, float(b)) for i, (a, b) in enumerate(zip(t, y, strict=True)) if not (96 * 25 <= i < 96 * 25 + 60)], "ts timestamp_ntz, y double")
    got = backtest.backtest(df, "y", "2024-01-20")
    assert got.select("day").distinct().count() == 10  # one of eleven days has too few rows
    assert got.agg(F.max(F.abs(F.col("actual") - F.col("forecast")))).first()[0] < 0.5


def test_registry(spark):
    runs = spark.createDataFrame([("a", "n", T0, {}, {"brier": 0.05}, {}, True), ("b", "n", T0 + dt.timedelta(1), {}, {"brier": 0.04}, {}, True), ("c", "n", T0, {}, {"brier": 0.04}, {}, False), ("d", "n", T0, {}, {"brier": 0.03}, {}, False)], registry.RUNS)
    champion = registry.latest_promoted(runs)
    assert tuple(champion.first()) == ("b", 0.04) and registry.latest_promoted(runs.limit(0)).first().brier == 0.0623
    assert {r.run_id: r.promote for r in registry.promotion(runs.where("not promoted"), champion).collect()} == {"c": False, "d": True}


def test_description(spark):
    row = spark.createDataFrame([(610.4, 130, 200.0, 2.5, 900.0, 1300.0)], "peak_price double, duration_min int, mean_threshold double, mean_wind_error double, mean_abs_flow double, max_abs_flow double")
    assert events.described(row).first().description == (
        "Severe aFRR price spike: sustained 130-minute event, peak 610 EUR/MWh (3.1x threshold). Driven by small German forecast deviation of 2 MW and elevated unplanned flow averaging 900 MW "
        "(peaking at 1300 MW, near the 1250 MW bottleneck). Market context: narrow day-ahead price spread DE-CH of 0 EUR/MWh, during normal Swiss demand."
    )


def test_files(spark, tmp_path):
    head = ",".join(f"h{i}" for i in range(23))
    lines = [head, head] + [",".join(["01.03.2024 00:%02d" % m] + [str(i) if i != 21 else "x" for i in range(1, 23)]) for m in (0, 15)]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    got = files.read_sheet(spark, [str(tmp_path / "s.csv")])
    assert got.count() == 2 and got.first().pos_sec_price is None and got.first().neg_sec_price == 22.0
    df = spark.createDataFrame([(T0, 1.0), (T0 + dt.timedelta(1), 2.0)], "ts timestamp_ntz, v double")
    files.write_dated(df, str(tmp_path / "d"))
    files.write_dated(df.where("v = 2").withColumn("v", F.lit(5.0)), str(tmp_path / "d"))
    assert sorted(r.v for r in files.read_dated(spark, str(tmp_path / "d")).collect()) == [1.0, 5.0]
    assert files.read_dated(spark, str(tmp_path / "d"), "2024-01-02").count() == 1
    years = spark.createDataFrame([(2022, 1), (2023, 2)], "year int, v int")
    assert [files.year_or_latest(years, y).first().v for y in (2022, 2025)] == [1, 2]
    grid = df.select("ts")
    assert files.assembled(grid, {"a": df.select("ts", F.col("v").alias("value"))}, ["a", "absent"]).columns == ["ts", "a", "absent"]


def test_streams(spark, tmp_path):
    rows = [(i, "s", T0 + dt.timedelta(minutes=m), float(m)) for i, m in enumerate([0, 15, 45, 200, 215, 3000])]
    df = spark.createDataFrame(rows, "k long, s string, ts timestamp, p double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(s, name, mode="append"):
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    got = run(streams.episode_stream(stream, F.col("p") >= 0, "p", ["s"]), "episodes").orderBy("start_ts").collect()
    assert [(r.n_intervals, r.duration_min) for r in got] == [(3, 60), (2, 30)]
    assert run(streams.flagged_rows(stream, [Rule("g", "range", "p", 0, 100), Rule("g", "non_negative", "p")]), "rules").count() == 3
    assert run(streams.rows_by_window(stream, window="1 day", late="1 hour"), "days").first().n == 5
    assert pytest.approx(20.0) == run(streams.window_means(stream, ["p"]), "means").orderBy("start").first().p
