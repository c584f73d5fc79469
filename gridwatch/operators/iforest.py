"""Isolation forest: trees grown in parallel on hash-picked rows, rows scored against the broadcast forest.

The forest holds ``trees`` trees of at most ``2 * rows`` nodes, so its size is bounded by its parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import kept
from .selection import quantiles

NODES = "tree int, node int, feature int, cut double, left int, right int, size int"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.maximum(np.asarray(n, dtype=float), 1)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow(df: DataFrame, columns: list[str], key: str, trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """The node table of the forest. One seeded sample of ``trees * rows`` rows is dealt out to the trees."""
    clean = df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    sample = clean.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(trees * rows)
    # a bounded sample: its place decides the tree
    dealt = sample.withColumn("tree", ((F.row_number().over(W.orderBy(F.xxhash64(key, F.lit(seed)), key)) - 1) % trees).cast("int"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        x = part.sort_values(key)[columns].to_numpy(dtype=float)
        rng, out, limit = np.random.default_rng([seed, tree]), [], int(np.ceil(np.log2(max(len(x), 2))))

        def split(at: np.ndarray, depth: int) -> int:
            node = len(out)
            out.append([tree, node, -1, 0.0, -1, -1, len(at)])
            low, high = x[at].min(axis=0), x[at].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(at) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(low[f], high[f]))
                under = x[at, f] < cut
                if under.any() and not under.all():
                    out[node][2:4] = [f, cut]
                    out[node][4] = split(at[under], depth + 1)
                    out[node][5] = split(at[~under], depth + 1)
            return node

        split(np.arange(len(x)), 0)
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    return dealt.groupBy("tree").applyInPandas(one, NODES)


def score(df: DataFrame, forest: DataFrame, columns: list[str], rows: int = 256) -> DataFrame:
    """``df`` without rows that hold nulls, and ``anomaly_score``: -1 (odd) to 0."""
    nodes = forest.toPandas()  # bounded by the forest's parameters
    trees = [t.sort_values("node") for _, t in nodes.groupby("tree")]
    packed = [tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "size")) for t in trees]
    shared = df.sparkSession.sparkContext.broadcast(packed)
    schema = df.withColumn("anomaly_score", F.lit(None).cast("double")).schema
    norm = float(average_path(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[columns].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for feature, cut, left, right, size in shared.value:
                at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
                while (inner := feature[at] >= 0).any():
                    i = np.flatnonzero(inner)
                    n = at[i]
                    at[i] = np.where(x[i, feature[n]] < cut[n], left[n], right[n])
                    depth[i] += 1
                total += depth + average_path(size[at])
            yield b.assign(anomaly_score=-(2.0 ** -(total / len(shared.value) / norm)))

    return df.dropna(subset=columns).mapInPandas(run, schema)


def flagged(scored: DataFrame, contamination: float = 0.05, offset: float | None = None) -> DataFrame:
    """``is_anomaly``: below the offset, which is the score's quantile at ``contamination`` over the training rows."""
    if offset is not None:
        return scored.withColumn("is_anomaly", F.col("anomaly_score") < offset)
    scored = kept(scored, "anomaly-scores")  # scores are costly, and selection reads them several times
    (cut,) = quantiles(scored, {"anomaly_score": [contamination]})["anomaly_score"]
    return scored.withColumn("offset", F.lit(cut).cast("double")).withColumn("is_anomaly", F.col("anomaly_score") < F.col("offset"))
