"""Sources, sinks, streams, the run log and small operators that no registered query shows."""

import datetime as dt
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwatch.operators import aggregates, attribution, features, quality, registry, stats, training
from gridwatch.operators.boosting import Forest, Tree
from gridwatch.plans import models
from gridwatch.sources import files, once
from gridwatch.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_csv_by_header_and_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("when,x,y\n2024-01-01 00:00:00,1.5,NaN\n2024-01-01 00:15:00,,2\n")
    schema = "when timestamp_ntz, x double, y double"
    got = files.read_csv(spark, str(tmp_path / "a.csv"), schema).orderBy("when").collect()
    assert [tuple(r) for r in got] == [(T0, 1.5, None), (T0 + dt.timedelta(minutes=15), None, 2.0)]
    assert files.read_csv(spark, str(tmp_path / "a.csv"), schema, ["ts", "price", "flow"]).columns == ["ts", "price", "flow"]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, s string")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_csv(df, str(tmp_path / "c"))  # a rerun replaces
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True, schema="k int, s string").collect())) == [(1, "a,b"), (2, None)]
    files.write_metrics(df, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["k"]) == [{"k": 1, "s": "a,b"}, {"k": 2}]


def some_labels(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(T0 + dt.timedelta(minutes=15 * i), i, float(a), float(b), int(a + 0.3 * b + rng.normal() > 0.4)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "ts timestamp_ntz, idx bigint, a double, b double, y int")


def test_pipelines_score_the_same_after_loading(spark, tmp_path):
    df = some_labels(spark)
    model = training.fit_boosted(df, ["a", "b"], "y", rounds=3)
    files.save_model(model, str(tmp_path / "m"))
    before, after = (training.raw_scores(m, df).select("idx", "prob_raw") for m in (model, files.load_model(spark, str(tmp_path / "m"))))
    assert before.exceptAll(after).count() == 0
    nodes = spark.createDataFrame([(0, 1.5)], "node int, cut double")
    files.save_model(nodes, str(tmp_path / "n"))
    assert files.load_model(spark, str(tmp_path / "n")).collect() == nodes.collect()


def test_forests_survive_saving(spark, tmp_path):
    t = Tree([1, -1, -1], [0.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 0.1, -0.2], [9.0, 4.0, 5.0])
    for trees in ([t, t], []):
        forest = Forest(["a", "b"], -0.7, trees)
        registry.save_forest(spark, forest, str(tmp_path / "f"))
        assert registry.load_forest(spark, str(tmp_path / "f")) == forest


def test_runs_are_appended(spark, tmp_path):
    for k in ("a", "b"):
        registry.append_run(str(tmp_path / "runs"), spark.createDataFrame([(k, "n", T0, {"p": "1"}, {"brier": 0.05}, {}, True)], registry.RUNS))
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == ["a", "b"]
    decisions = spark.createDataFrame([("c", 0.04, True), ("d", 0.03, True), ("e", 0.01, False)], "run_id string, challenger_value double, promote boolean")
    assert tuple(registry.active_pointer(decisions, F.lit(T0)).first()) == ("d", T0)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_one_of_many_writers_swaps(spark, tmp_path, scheme):
    active = registry.Active(spark, f"{scheme}{tmp_path}/active")
    assert active.read() == (0, None)
    assert active.swap("first", 0) and not active.swap("late", 0) and active.read() == (1, "first")
    won, start = [], threading.Barrier(8)

    def run(i):
        start.wait()
        if active.swap(f"r{i}", 1):
            won.append(f"r{i}")

    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and active.read() == (2, won[0])
    (tmp_path / "active" / ".0000000003.json-x").write_text("{")  # a writer that failed halfway
    assert active.read() == (2, won[0])


def test_listings(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "date date, v int")
    files.write_dated(df, str(tmp_path / "raw"))
    files.write_dated(df.where("v = 2").withColumn("date", F.lit(dt.date(2024, 1, 3))).unionByName(df.where("v = 1")), str(tmp_path / "f"))
    assert once.partition_values(spark, str(tmp_path / "raw")) == ["2024-01-01", "2024-01-02"]
    got = quality.stage_listing(spark, str(tmp_path / "raw"), str(tmp_path / "f"), str(tmp_path / "absent"))
    assert [tuple(r) for r in got.collect()] == [(dt.date(2024, 1, 3), "features without raw")]
    assert "FileScan" not in got._jdf.queryExecution().toString()


def test_counts_observed_in_one_job(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 3), (None, 4), (5, 6)], "a int, b int").repartition(2)
    spark.sparkContext.setJobGroup("observed", "")
    counts = features.write_complete(df, ["a", "b"], str(tmp_path / "w"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("observed")
    spark.sparkContext.setJobGroup("others", "")
    plain = spark.createDataFrame([(1, 2)], "a int, b int").repartition(2)
    spark.sparkContext.setJobGroup("plain", "")
    plain.write.parquet(str(tmp_path / "p"))
    alone = spark.sparkContext.statusTracker().getJobIdsForGroup("plain")
    spark.sparkContext.setJobGroup("others", "")
    assert counts == {"n_kept": 2, "n_dropped": 2} and spark.read.parquet(str(tmp_path / "w")).count() == 2
    assert len(jobs) == len(alone)  # as many as the write alone needs


def test_replayed_batches_leave_the_same_rows(spark, tmp_path):
    rows = [(i % 4, T0 + dt.timedelta(minutes=i), float(i)) for i in range(8)]
    spark.createDataFrame(rows, "k int, ts timestamp, p double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp, p double").parquet(str(tmp_path / "in"))
    out, seen = str(tmp_path / "out"), []

    def predict(b):
        seen.append(b.count())
        return b.withColumn("score", F.col("p") / 2)

    def run():
        q = streams.scored_to(stream, predict, out, str(tmp_path / "ck"), keys=["k"]).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.k, r.score) for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 4 and {k for k, _ in first} == {0, 1, 2, 3}  # repeats within a day went
    for f in (tmp_path / "ck" / "commits").iterdir():
        f.unlink()  # the batch was written, but not known to be: it is run again
    calls = len(seen)
    assert run() == first and len(seen) > calls


def test_go_or_no_go(spark):
    tests = spark.createDataFrame([("x", 0.2), ("x", 0.04), ("y", 0.3), ("z", None)], "causal_link string, p_value double")
    assert [stats.any_significant(tests, k).first().go for k in ("x", "y", "z", "w")] == [True, False, False, False]


def test_cross_validation(spark):
    got = training.cross_validated(some_labels(spark, 240), ["a", "b"], "y", folds=2, rounds=2).orderBy("fold").collect()
    assert [r.fold for r in got] == [-1, 0, 1] and got[0].brier == pytest.approx((got[1].brier + got[2].brier) / 2)
    assert got[0].sd_brier == pytest.approx(abs(got[1].brier - got[2].brier) / 2) and all(0 <= r.roc_auc <= 1 for r in got)


def test_tables_of_attributions(spark):
    found = spark.createDataFrame([(i, f, float(i), a) for i in (1, 2, 3) for f, a in (("a", 0.1 * i), ("b", -0.2))], "k int, feature string, value double, attribution double")
    table = attribution.interaction_table(found, "a", "b", "k").orderBy("k").collect()
    assert [(r.k, r.a, r.b, r.attribution) for r in table] == [(i, float(i), float(i), pytest.approx(0.1 * i)) for i in (1, 2, 3)]
    scored = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.9), (3, 1, 0.8)], "k int, y int, prob_raw double")
    assert [(r.k, r.feature) for r in attribution.local_explanation(found, scored, "k", "y", n=1).collect()] == [(3, "a")]
    assert attribution.local_explanation(found, scored.where("k < 3"), "k", "y", n=2).first().k == 1


def test_seeded_sample_ignores_partitions(spark):
    df = spark.range(500)
    a, b = (sorted(r.id for r in aggregates.sampled(df.repartition(n), 20, "id").collect()) for n in (1, 7))
    assert a == b and len(set(a)) == 20 and a != sorted(r.id for r in aggregates.sampled(df, 20, "id", seed=1).collect())


def test_column_gate(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 2)], "x int, z int")
    assert quality.column_gate(a, ["x", "q"], b) == [("q", "missing"), ("y", "only_left"), ("z", "only_right")]
    with pytest.raises(ValueError, match="rows"):
        quality.require_schema(a, [quality.Field("x", type="int")], least_rows=2)


def test_models_have_queries():
    from gridwatch.plans import catalogue

    assert {"granger_go", "monotone_scores", "tree_attributions", "tree_interactions"} <= set(catalogue.queries()) and models.BACKGROUND == 5000
