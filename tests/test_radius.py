"""The radius index finds all neighbours, with work in proportion to spread rows; silhouettes against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from gridwatch.operators import cluster, radius


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "k long, v array<double>").repartition(4)


def neighbours(near, eps, block=2000):
    def found(p, q):
        if not len(p):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        i, j = np.nonzero(radius.distances(np.stack(p["v"].to_numpy()), np.stack(q["v"].to_numpy())) <= eps)
        return pd.DataFrame({"a": p["id"].to_numpy()[i], "b": q["id"].to_numpy()[j]})

    return sorted((r.a, r.b) for r in radius.in_cells(near, found, "a bigint, b bigint", block).collect())


@pytest.mark.parametrize(("dims", "eps"), [(1, 0.2), (3, 0.8), (8, 2.0)])
def test_every_pair_is_met_once(spark, dims, eps):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.uniform(0, 6, (500, dims)), np.repeat(rng.uniform(0, 6, (1, dims)), 60, axis=0)])
    near = radius.cells(frame(spark, x), "k", "v", eps, leaf=25, fan=6)
    assert near.where("member").count() == len(x) == near.where("member").select("id").distinct().count()
    assert dims == 8 or near.select("cell").distinct().count() > 3  # so many dimensions leave nothing to be gained
    a, b = np.nonzero(radius.distances(x, x) <= eps)
    want = list(zip(a.tolist(), b.tolist()))
    assert neighbours(near, eps) == want
    assert neighbours(near, eps, block=20) == want  # large cells in several groups


def test_work_grows_like_the_rows(spark):
    work = {}
    for n in (2000, 16000):  # eight times the rows over eight times the area
        x = np.random.default_rng(1).uniform(0, math.sqrt(n), (n, 2))
        work[n] = radius.pairs(radius.cells(frame(spark, x), "k", "v", 0.5, leaf=100))
    assert math.log(work[16000] / work[2000]) / math.log(8) < 1.2
    assert work[16000] < 16000**2 / 50


def test_no_rows_and_equal_rows(spark):
    assert radius.cells(frame(spark, [[0.0]]).limit(0), "k", "v", 1.0).count() == 0
    same = radius.cells(frame(spark, [[1.0, 2.0]] * 50), "k", "v", 0.1, leaf=5)
    assert same.where("member").count() == 50 and len(neighbours(same, 0.1)) == 2500


def silhouette_by_pairs(x, label, squared):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = d**2 if squared else d
    out = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("squared", [False, True])
def test_silhouette_against_pairs(spark, squared):
    rng = np.random.default_rng(3)
    label = np.array([0] * 40 + [1] * 30 + [2] * 20 + [3])
    x = rng.normal(0, 1, (91, 4)) + label[:, None] * 1.5 + 1000
    df = spark.createDataFrame([(i, [float(v) for v in a], int(c)) for i, (a, c) in enumerate(zip(x, label))] + [(99, [0.0] * 4, -1)], "k long, v array<double>, c int")
    got = cluster.silhouette(df, "k", "v", "c", pairwise=0 if squared else 1000).first()
    assert got.silhouette == pytest.approx(silhouette_by_pairs(x, label, squared), abs=1e-9)
    assert (got.n_points, got.n_clusters, got.metric) == (91, 4, "squared_euclidean" if squared else "euclidean")
