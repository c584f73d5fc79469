"""Exact selection against SQL's percentile and against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwatch.operators import selection
from gridwatch.operators.selection import quantiles

FRACTIONS = [0, 0.01, 0.25, 0.5, 0.731, 0.9, 1]


def want(df, column, fractions=FRACTIONS):
    return df.agg(F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, fractions))).alias("q")).first()["q"]


def rows_of(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1), rng.choice([None, 1, 2, 2, 2, 2, 7]), 10 ** rng.uniform(-300, 300), None, 5.0, i) for i in range(3000)]
    return spark.createDataFrame(rows, "a double, b int, c double, d double, e double, f bigint").repartition(7)


def test_equals_percentile(spark):
    df = rows_of(spark, 1)
    got = quantiles(df, dict.fromkeys("abcdef", FRACTIONS))
    for c in "abcef":
        assert got[c] == pytest.approx(want(df, c), rel=1e-12), c
    assert got["d"] == [None] * len(FRACTIONS)


@pytest.mark.parametrize("left", [1, 300])
def test_narrows_to_few_rows(spark, left):
    df, some = rows_of(spark, left), [0.3, 0.9]
    got = quantiles(df, dict.fromkeys("abc", some), left)
    for c in "abc":
        assert got[c] == pytest.approx(want(df, c, some), rel=1e-12), c


def test_few_rows_and_odd_values(spark):
    df = spark.createDataFrame([(math.nan, 1.0), (1.0, -math.inf), (None, 0.0), (2.0, math.inf)], "x double, y double")
    got = quantiles(df, {"x": [0, 0.5, 1], "y": [0, 0.5]})
    assert got["x"][:2] == [1.0, 2.0] and math.isnan(got["x"][2]) and got["y"] == [-math.inf, 0.5]
    assert quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]} and quantiles(df, {}) == {}


def test_ten_million_distinct_values(spark):
    n = 10_000_000
    x = (F.col("id") * 7919 % n).cast("double")  # all of 0 to n - 1, shuffled
    df = spark.range(0, n, 1, 8).select(x.alias("x"), (x * x).alias("y"))
    got = quantiles(df, {"x": [0.1, 0.5, 0.999], "y": [0.25]})
    assert got["x"] == pytest.approx([q * (n - 1) for q in (0.1, 0.5, 0.999)], rel=1e-12)
    low = math.floor(0.25 * (n - 1))
    assert got["y"][0] == pytest.approx(np.interp(0.25 * (n - 1), [low, low + 1], [low**2, (low + 1) ** 2]), rel=1e-12)


def test_a_misleading_sketch_costs_rounds_only(spark, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 30)
    monkeypatch.setattr(selection, "REACH", 0.01)
    df = spark.range(5000).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    assert quantiles(df, {"x": [0.1, 0.77]}, 20)["x"] == pytest.approx(want(df, "x", [0.1, 0.77]), rel=1e-12)


def test_no_operator_asks_for_a_keyless_percentile():
    import pathlib

    import gridwatch.operators as o

    for f in pathlib.Path(o.__file__).parent.glob("*.py"):
        if f.name != "windows.py":  # there over frames of rows
            assert "F.percentile(" not in f.read_text(), f.name
