"""Exact attributions of boosted trees to features and to pairs of features, without sampling.

With some features known, a tree's expected value follows the known features' splits and weighs both sides of the others
by the rows that they covered in training. That game is a sum over leaves: a leaf's value times, for each feature on
its path, whether the row meets the path's conditions on it (known) or the share of rows that do (unknown).
Paths hold few features, so every subset of them is weighed, for all rows of a batch at once. A row's attributions add up to its margin less
the forest's expected margin; its interactions add up to its attributions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, Tree


@dataclass
class _Leaf:
    value: float
    features: list[int]
    tests: list[list[tuple[float, bool]]]  # for each feature: cut and whether the path goes left
    shares: np.ndarray


def _leaves(tree: Tree) -> list[_Leaf]:
    out, todo = [], [(0, {}, {})]
    while todo:
        node, tests, shares = todo.pop()
        f = tree.feature[node]
        if f < 0:
            names = sorted(tests)
            out.append(_Leaf(tree.value[node], names, [tests[n] for n in names], np.array([shares[n] for n in names])))
            continue
        for side, left in ((tree.left[node], True), (tree.right[node], False)):
            share = tree.cover[side] / (tree.cover[tree.left[node]] + tree.cover[tree.right[node]])
            todo.append((side, {**tests, f: [*tests.get(f, []), (tree.cut[node], left)]}, {**shares, f: shares.get(f, 1.0) * share}))
    return out


def expected_margin(forest: Forest) -> float:
    """The mean margin over the rows that the trees covered."""
    return forest.base + sum(leaf.value * leaf.shares.prod() for t in forest.trees for leaf in _leaves(t))


def _met(leaf: _Leaf, x: np.ndarray) -> np.ndarray:
    """For each row and feature of the path, 1 where the row meets its conditions."""
    met = np.ones((len(x), len(leaf.features)))
    for j, (f, tests) in enumerate(zip(leaf.features, leaf.tests, strict=True)):
        for cut, left in tests:
            met[:, j] *= (x[:, f] <= cut) == left
    return met


def _weighed(met: np.ndarray, shares: np.ndarray, without: tuple[int, ...]) -> np.ndarray:
    """The mean, by Shapley's weights, over the known subsets of the path's other features, of the product of their factors."""
    rest = [j for j in range(len(shares)) if j not in without]
    n, k = len(shares), len(without)
    total = np.zeros(len(met))
    for size in range(len(rest) + 1):
        weight = factorial(size) * factorial(n - size - k) / factorial(n - k + 1)
        for known in combinations(rest, size):
            term = np.full(len(met), weight)
            for j in rest:
                term = term * (met[:, j] if j in known else shares[j])
            total += term
    return total


def attributed(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Attributions of each row (rows by features)."""
    out = np.zeros((len(x), len(forest.features)))
    for tree in forest.trees:
        for leaf in _leaves(tree):
            met = _met(leaf, x)
            for j, f in enumerate(leaf.features):
                out[:, f] += leaf.value * (met[:, j] - leaf.shares[j]) * _weighed(met, leaf.shares, (j,))
    return out


def interacting(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Interactions of each row (rows by features by features): half of a pair's joint effect in either place, and what is a feature's own in the diagonal."""
    k = len(forest.features)
    out = np.zeros((len(x), k, k))
    for tree in forest.trees:
        for leaf in _leaves(tree):
            met = _met(leaf, x)
            for i, j in combinations(range(len(leaf.features)), 2):
                both = leaf.value * (met[:, i] - leaf.shares[i]) * (met[:, j] - leaf.shares[j]) * _weighed(met, leaf.shares, (i, j)) / 2
                a, b = leaf.features[i], leaf.features[j]
                out[:, a, b] += both
                out[:, b, a] += both
    own = attributed(forest, x) - out.sum(axis=2)
    out[:, np.arange(k), np.arange(k)] = own
    return out


def _rows(df: DataFrame, forest: Forest, key: str) -> DataFrame:
    return df.dropna(subset=forest.features).select(key, F.array(*(F.col(f).cast("double") for f in forest.features)).alias("x"))


def tree_attributions(forest: Forest, rows: DataFrame, key: str) -> DataFrame:
    """``key, feature, value, attribution`` of every row without nulls in the features, exact on the margin's scale."""
    source, k = _rows(rows, forest, key), len(forest.features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["x"].to_numpy()) if len(f) else np.zeros((0, k))
            yield pd.DataFrame({key: np.repeat(f[key].to_numpy(), k), "feature": np.tile(forest.features, len(f)), "value": x.ravel(), "attribution": attributed(forest, x).ravel()})

    return source.mapInPandas(run, f"{key} {source.schema[key].dataType.simpleString()}, feature string, value double, attribution double")


def tree_interactions(forest: Forest, rows: DataFrame, key: str) -> DataFrame:
    """``key, feature, other, interaction``: each unordered pair once with its whole effect, and each feature with itself."""
    source, k = _rows(rows, forest, key), len(forest.features)
    a, b = np.triu_indices(k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(forest.features)
        for f in frames:
            x = np.stack(f["x"].to_numpy()) if len(f) else np.zeros((0, k))
            pairs = interacting(forest, x)[:, a, b] * np.where(a == b, 1.0, 2.0)
            yield pd.DataFrame({key: np.repeat(f[key].to_numpy(), len(a)), "feature": np.tile(names[a], len(f)), "other": np.tile(names[b], len(f)), "interaction": pairs.ravel()})

    return source.mapInPandas(run, f"{key} {source.schema[key].dataType.simpleString()}, feature string, other string, interaction double")
