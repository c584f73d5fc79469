"""Boosted trees whose predictions rise or fall with chosen features, grown from histograms.

Features are cut into at most ``BINS`` bins at quantiles that a bounded sketch finds. One aggregation a level sums the gradients of every
open node by feature and bin; tasks send on at most nodes x features x bins rows, so what the driver sees doesn't grow
with the data. A split on a constrained feature must order the two sides' values, and their middle bounds
all values below each side, so the order holds for every row. Trees are node tables of bounded size: they travel in
the tasks' closures. Every ``KEEP`` trees the rows' margins are written anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept

BINS, KEEP = 64, 10
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tree:
    """Nodes by number, the root first. A row goes left where its feature is at most ``cut``; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in zip((self.feature, self.cut, self.left, self.right, self.value, self.cover), (-1, 0.0, -1, -1, value, cover), strict=True):
            column.append(x)
        return len(self.feature) - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x`` (rows by features)."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), dtype=int)
        while (rows := np.flatnonzero(feature[at] >= 0)).size:
            n = at[rows]
            at[rows] = np.where(x[rows, feature[n]] <= cut[n], left[n], right[n])
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


@dataclass
class Forest:
    """Trees over ``features``; a row's margin is ``base`` and the sum of its leaves' values, its probability the logistic of it."""

    features: list[str]
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.margin(x) for t in self.trees), np.zeros(len(x)))

    def scores(self, df: DataFrame, to: str = "prob_raw") -> DataFrame:
        """``df`` without rows that hold nulls in the features, and the probability of the positive class."""

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-self.margin(rows.to_numpy(dtype=float)))))

        return df.dropna(subset=self.features).withColumn(to, score(F.struct(*(F.col(f).cast("double").alias(f) for f in self.features))))


@dataclass(frozen=True)
class Settings:
    rounds: int = 30
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.6
    positive_weight: float = 9.0
    least_weight: float = 30.0
    gamma: float = 3.0
    alpha: float = 0.5
    lambda_: float = 2.0
    bins: int = BINS
    seed: int = 42

    def weight(self, g: np.ndarray, h: np.ndarray, low: float, high: float) -> np.ndarray:
        """The best value of a node of gradient ``g`` and curvature ``h`` between its bounds."""
        w = -np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0) / (h + self.lambda_)
        return np.clip(w, low, high)

    def gain(self, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How much a node of value ``w`` lowers the penalised loss."""
        return -(g * w + 0.5 * (h + self.lambda_) * w * w + self.alpha * np.abs(w))


@dataclass
class _Open:
    node: int
    low: float
    high: float


def _best(s: Settings, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, signs: np.ndarray, node: _Open) -> tuple[int, int, float, float] | None:
    """Feature, bin and the two sides' values of the best split of a node's histogram (features by bins)."""
    gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    gt, ht = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
    gr, hr = gt - gl, ht - hl
    wl, wr = s.weight(gl, hl, node.low, node.high), s.weight(gr, hr, node.low, node.high)
    whole = s.gain(gt, ht, s.weight(gt, ht, node.low, node.high))
    gain = s.gain(gl, hl, wl) + s.gain(gr, hr, wr) - whole - s.gamma
    wrong = (signs[:, None] * (wr - wl) < 0) | (hl < s.least_weight) | (hr < s.least_weight) | ~allowed[:, None]
    gain = np.where(wrong, -np.inf, gain)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(b), float(wl[f, b]), float(wr[f, b])) if gain[f, b] > 0 else None


def _picked(ids: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Which rows a tree learns from: a share, by a hash of the row's number."""
    x = (ids.astype(np.uint64) + np.uint64(s.seed * 1_000_003 + tree + 1)) * _STEP
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(float) < s.rows * (1 << 24)


def _rows(df: DataFrame, features: list[str], label: str, held: str | None) -> DataFrame:
    """``id, x, y, held, margin``: kept rows that the trees learn from or are chosen by."""
    clean = df.dropna(subset=[*features, label])
    x = F.array(*(F.col(f).cast("double") for f in features))
    return clean.select(F.monotonically_increasing_id().alias("id"), x.alias("x"), F.col(label).cast("double").alias("y"), (F.col(held) if held else F.lit(False)).alias("held"), F.lit(0.0).alias("margin"))


def _moved(rows: DataFrame, trees: list[Tree], name: str) -> DataFrame:
    """The rows with the trees' values in their margins, written anew."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["x"].to_numpy()) if len(f) else np.zeros((0, 1))
            yield f.assign(margin=f["margin"] + sum(t.margin(x) for t in trees))

    return kept(rows.mapInPandas(run, rows.schema), name)


def _histograms(rows: DataFrame, base: float, trees: list[Tree], tree: Tree, number: int, nodes: list[int], edges: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and curvatures by open node, feature and bin, in one aggregation."""
    slots = {n: i for i, n in enumerate(nodes)}
    shape = (len(nodes), len(edges), s.bins)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros(shape), np.zeros(shape)
        for f in frames:
            f = f[_picked(f["id"].to_numpy(), number, s)]
            if not len(f):
                continue
            x, y = np.stack(f["x"].to_numpy()), f["y"].to_numpy()
            p = 1 / (1 + np.exp(-(base + f["margin"].to_numpy() + sum(t.margin(x) for t in trees))))
            weight = np.where(y == 1, s.positive_weight, 1.0)
            slot = np.array([slots.get(n, -1) for n in range(len(tree.feature))])[tree.leaves(x)]
            own = slot >= 0
            for j, e in enumerate(edges):
                at = slot[own] * s.bins + np.searchsorted(e, x[own, j], side="left")
                g[:, j] += np.bincount(at, (weight * (p - y))[own], shape[0] * s.bins).reshape(shape[0], -1)
                h[:, j] += np.bincount(at, (weight * p * (1 - p))[own], shape[0] * s.bins).reshape(shape[0], -1)
        cells = np.flatnonzero(h.ravel())
        yield pd.DataFrame({"cell": cells, "g": g.ravel()[cells], "h": h.ravel()[cells]})

    sums = rows.where("not held").select("id", "x", "y", "margin").mapInPandas(run, "cell bigint, g double, h double")
    found = sums.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # nodes x features x bins at most
    g, h = np.zeros(shape).ravel(), np.zeros(shape).ravel()
    g[found["cell"]], h[found["cell"]] = found["g"], found["h"]
    return g.reshape(shape), h.reshape(shape)


def _grown(rows: DataFrame, base: float, recent: list[Tree], number: int, edges: list[np.ndarray], signs: np.ndarray, s: Settings) -> Tree:
    rng = np.random.default_rng([s.seed, number])
    allowed = np.zeros(len(edges), dtype=bool)
    allowed[rng.choice(len(edges), max(1, round(s.columns * len(edges))), replace=False)] = True
    tree = Tree()
    level = [_Open(tree.add(0.0, 0.0), -np.inf, np.inf)]
    for depth in range(s.depth + 1):
        if not level:
            break
        g, h = _histograms(rows, base, recent, tree, number, [o.node for o in level], edges, s)
        following = []
        for o, gi, hi in zip(level, g, h, strict=True):
            total_g, total_h = gi[0].sum(), hi[0].sum()
            tree.value[o.node], tree.cover[o.node] = s.rate * float(s.weight(total_g, total_h, o.low, o.high)), float(total_h)
            split = _best(s, gi, hi, allowed, signs, o) if depth < s.depth else None
            if split is None:
                continue
            f, b, wl, wr = split
            middle = (wl + wr) / 2
            left, right = tree.add(0.0, 0.0), tree.add(0.0, 0.0)
            tree.feature[o.node], tree.cut[o.node], tree.left[o.node], tree.right[o.node] = f, float(edges[f][b]), left, right
            # what lies below a side of a constrained split stays on that side of the middle
            low, high = (o.low, o.high), (o.low, o.high)
            if signs[f] > 0:
                low, high = (o.low, middle), (middle, o.high)
            elif signs[f] < 0:
                low, high = (middle, o.high), (o.low, middle)
            following += [_Open(left, *low), _Open(right, *high)]
        level = following
    return tree


def _held_losses(rows: DataFrame, base: float, trees: list[Tree], weight: float) -> np.ndarray:
    """The held rows' loss after each tree, in one scan."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(trees))
        for f in frames:
            x, y = np.stack(f["x"].to_numpy()), f["y"].to_numpy()
            margin = np.full(len(f), base)
            for i, t in enumerate(trees):
                margin = margin + t.margin(x)
                total[i] += (np.where(y == 1, weight, 1.0) * (np.logaddexp(0, margin) - y * margin)).sum()
        yield pd.DataFrame({"i": range(len(trees)), "loss": total})

    found = rows.where("held").select("x", "y").mapInPandas(run, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).toPandas()
    return found.sort_values("i")["loss"].to_numpy()


def fit_forest(df: DataFrame, features: list[str], label: str, monotone: Mapping[str, int] | None = None, held: str | None = None, settings: Settings | None = None, **options) -> Forest:
    """Boosted trees of the probability that ``label`` is 1. ``monotone`` maps features to 1 (the prediction never falls when the
    feature rises) or -1. Rows where the boolean ``held`` is true aren't learnt from: the trees up to the least loss
    on them are kept. Rows with nulls in features or label are left out; without rows of both labels there are no trees."""
    s = settings or Settings(**options)
    rows = kept(_rows(df, features, label, held), "boosting")
    one = rows.where("not held").agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    if not one["n"] or not 0 < one["y"] < one["n"]:
        return Forest(features, 0.0, [])
    positive = one["y"] * s.positive_weight
    base = float(np.log(positive / (one["n"] - one["y"])))
    places = F.array(*(F.lit(k / s.bins) for k in range(1, s.bins)))
    cuts = rows.where("not held").agg(*(F.percentile_approx(F.col("x")[i], places, 10_000).alias(f"c{i}") for i in range(len(features)))).first()
    edges = [np.unique(cuts[f"c{i}"]) for i in range(len(features))]
    edges = [np.concatenate([e, np.full(s.bins - 1 - len(e), np.inf)]) for e in edges]
    signs = np.array([(monotone or {}).get(f, 0) for f in features])
    trees: list[Tree] = []
    for number in range(s.rounds):
        recent = trees[number - number % KEEP :]
        if number and not number % KEEP:
            rows = _moved(rows, trees[number - KEEP : number], "boosting")
        trees.append(_grown(rows, base, recent, number, edges, signs, s))
    if held and (losses := _held_losses(rows, base, trees, s.positive_weight)).size:
        trees = trees[: int(losses.argmin()) + 1]
    return Forest(features, base, trees)
