"""Monotone boosted trees, and their attributions against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwatch.operators import tree_attribution
from gridwatch.operators.boosting import Forest, Tree, fit_forest

NAMES = ["a", "b", "c", "d", "e", "f"]


def sample(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).round(2)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.8 * x[:, 2] * x[:, 3] - 1)))
    return x, (rng.random(n) < p).astype(int)


def loss(forest, x, y):
    m = forest.margin(x)
    return (np.logaddexp(0, m) - y * m).mean()


@pytest.fixture(scope="module")
def fitted(spark):
    x, y = sample()
    df = spark.createDataFrame([(*map(float, r), int(v), i >= 2400) for i, (r, v) in enumerate(zip(x, y))], ", ".join(f"{n} double" for n in NAMES) + ", y int, held boolean").repartition(4)
    options = {"rounds": 8, "depth": 3, "rate": 0.3, "positive_weight": 1.0, "least_weight": 5.0, "gamma": 0.1, "bins": 32}
    free = fit_forest(df, NAMES, "y", held="held", **options)
    bound = fit_forest(df, NAMES, "y", {"a": 1, "b": -1}, held="held", **options)
    return df, x, y, free, bound


def test_constrained_features_only_rise(fitted):
    _, x, y, free, bound = fitted
    for forest, strict in ((bound, True), (free, False)):
        broken = 0
        for j, sign in ((0, 1), (1, -1)):
            before = None
            for v in np.linspace(-4, 4, 161):
                moved = x[:400].copy()
                moved[:, j] = v
                m = sign * forest.margin(moved)
                broken += 0 if before is None else int((m < before - 1e-12).sum())
                before = m
        assert (broken == 0) == strict  # without constraints some rows fall
    assert loss(bound, x, y) < 1.02 * loss(free, x, y) < 0.9 * np.log(2)


def test_scores_are_the_margins(spark, fitted):
    df, x, _, _, bound = fitted
    got = bound.scores(df).agg(F.sum("prob_raw"), F.count("*")).first()
    assert got[0] == pytest.approx((1 / (1 + np.exp(-bound.margin(x)))).sum()) and got[1] == len(x)
    assert bound.scores(df.withColumn("a", F.lit(None).cast("double"))).count() == 0


def test_no_trees_without_both_labels(spark, fitted):
    assert fit_forest(fitted[0].where("y = 1"), NAMES, "y").trees == [] and fit_forest(fitted[0].limit(0), NAMES, "y").trees == []


def known_value(tree, x, known, node=0):
    """A tree's expected value where only some features are known, down the tree."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        return known_value(tree, x, known, left if x[f] <= tree.cut[node] else right)
    sides = [(tree.cover[s], known_value(tree, x, known, s)) for s in (left, right)]
    return sum(c * v for c, v in sides) / sum(c for c, _ in sides)


def shapley(forest, x):
    k = len(forest.features)
    v = {s: sum(known_value(t, x, s) for t in forest.trees) for n in range(k + 1) for s in combinations(range(k), n)}
    one = [sum(factorial(len(s)) * factorial(k - len(s) - 1) / factorial(k) * (v[tuple(sorted({*s, i}))] - v[s]) for s in v if i not in s) for i in range(k)]
    two = np.zeros((k, k))
    for i, j in combinations(range(k), 2):
        for s in v:
            if i not in s and j not in s:
                w = factorial(len(s)) * factorial(k - len(s) - 2) / (2 * factorial(k - 1))
                two[i, j] += w * (v[tuple(sorted({*s, i, j}))] - v[tuple(sorted({*s, i}))] - v[tuple(sorted({*s, j}))] + v[s])
        two[j, i] = two[i, j]
    return np.array(one), two


def test_attributions_against_all_subsets(fitted):
    _, x, _, free, _ = fitted
    some = x[:12]
    got, pairs = tree_attribution.attributed(free, some), tree_attribution.interacting(free, some)
    for row, a, b in zip(some, got, pairs):
        one, two = shapley(free, row)
        assert a == pytest.approx(one, abs=1e-9)
        off = b - np.diag(np.diag(b))
        assert off == pytest.approx(two, abs=1e-9) and b.sum(axis=1) == pytest.approx(one, abs=1e-9)
    assert got.sum(axis=1) == pytest.approx(free.margin(some) - tree_attribution.expected_margin(free), abs=1e-9)


def test_attribution_tables(spark, fitted):
    df, _, _, free, _ = fitted
    rows = df.withColumn("k", F.monotonically_increasing_id()).limit(200)
    found = tree_attribution.tree_attributions(free, rows, "k")
    sums = found.groupBy("k").agg(F.sum("attribution").alias("s"))
    margin = free.scores(rows).select("k", F.log(F.col("prob_raw") / (1 - F.col("prob_raw"))).alias("m"))
    base = tree_attribution.expected_margin(free)
    assert sums.join(margin, "k").where(F.abs(F.col("s") + base - F.col("m")) < 1e-9).count() == 200
    pairs = tree_attribution.tree_interactions(free, rows, "k")
    assert pairs.count() == 200 * 21
    assert pairs.groupBy("k").agg(F.sum("interaction").alias("t")).join(sums, "k").where(F.abs(F.col("t") - F.col("s")) < 1e-9).count() == 200


def test_a_feature_twice_on_a_path():
    t = Tree([0, 0, -1, -1, -1], [1.0, 0.0, 0, 0, 0], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [0, 0, 5.0, 1.0, 2.0], [10, 6, 4, 1, 5])
    forest = Forest(["a", "b"], 0.5, [t])
    x = np.array([[-1.0, 0], [0.5, 0], [2.0, 0]])
    assert tree_attribution.attributed(forest, x)[:, 0] == pytest.approx(forest.margin(x) - tree_attribution.expected_margin(forest))
