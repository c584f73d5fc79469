"""Exact quantiles of many columns without a reducer that holds a column.

Each wanted rank has a closed interval of values that holds it. A round takes two scans of all columns at once: a sketch of
bounded size proposes a narrow interval around each rank, and counts of the values below and up to its ends say
whether the rank lies in it. Ranks come from counts only, so a poor proposal costs a round and never the result. When
few rows are left, the distinct values of the intervals and their counts come to the driver instead. Quantiles
are interpolated between order statistics as ``percentile`` does. Nulls don't count; NaN is the largest value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch, how far from a rank's share of the rows an interval reaches, and rows that are looked at one by one.
ACCURACY, REACH, LEFT = 10_000, 3 / 10_000, 100_000

#: Least and largest value, both inside.
Interval = tuple[float, float]


class _Column:
    """The search for the wanted ranks of one column."""

    def __init__(self, name: str, fractions: Sequence[float]):
        self.value = F.col(name).cast("double")
        self.name, self.fractions, self.n = name, list(fractions), 0
        self.known: dict[int, float] = {}
        self.within: dict[int, tuple[float, float, int, int]] = {}  # interval of a rank, values below it and up to its end
        self.asked: dict[int, list[Interval]] = {}

    def between(self, i: Interval) -> Column:
        return (self.value >= i[0]) & (self.value <= i[1])

    def start(self, nan: int, n: int, low: float | None, high: float | None, near: list[float]) -> None:
        """Begin with the whole column and the values that the sketch has near each fraction."""
        self.n = n
        for q, a, b in zip(self.fractions, near[::2], near[1::2], strict=True):
            for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))} if n else ():
                if rank >= n - nan or rank == 0 or rank == n - nan - 1:
                    self.known[rank] = math.nan if rank >= n - nan else low if rank == 0 else high
                else:
                    self.within[rank] = (low, high, 0, n - nan)
                    self._ask(rank, a, b)

    def _ask(self, rank: int, low: float, high: float) -> None:
        a, b = self.within[rank][:2]
        if (low, high) == (a, b) and a < b:  # nothing gained: take the ends apart
            inner = (math.nextafter(a, math.inf), math.nextafter(b, -math.inf))
            self.asked[rank] = [(a, a), *([inner] if inner[0] <= inner[1] else []), (b, b)]
        else:
            self.asked[rank] = [(low, high)]

    def shares(self) -> dict[Interval, list[tuple[int, float]]]:
        """Intervals with the ranks that are to be found in them and their shares of the interval's rows."""
        out: dict[Interval, list[tuple[int, float]]] = {}
        for rank, (a, b, below, upto) in sorted(self.within.items()):
            out.setdefault((a, b), []).append((rank, (rank - below) / (upto - below)))
        return out

    def left(self) -> float:
        return sum(2 * REACH * (self.within[r][3] - self.within[r][2]) + 2 for r in self.asked)

    def intervals(self) -> list[Interval]:
        return sorted({i for x in self.asked.values() for i in x})

    def place(self, counts: dict[Interval, tuple[int, int | None]], values: list[tuple[float, int]]) -> None:
        """Narrow the intervals by the values below and up to the ends of those asked for, or find the ranks among ``values``."""
        for rank, asked in self.asked.items():
            a, b, below, upto = self.within[rank]
            for i in asked:
                under, most = counts[i]
                inside = [(v, n) for v, n in values if i[0] <= v <= i[1]]
                most = under + sum(n for _, n in inside) if most is None else most
                if rank < under:
                    b, upto = math.nextafter(i[0], -math.inf), under
                    break
                if rank >= most:
                    a, below = math.nextafter(i[1], math.inf), most
                    continue
                a, b, below, upto = *i, under, most
                for v, n in inside:
                    under += n
                    if rank < under:
                        a = b = v
                        break
                break
            self.within[rank] = (a, b, below, upto)
            if a == b:
                self.known[rank] = a
        self.within = {r: x for r, x in self.within.items() if r not in self.known}
        self.asked = {}

    def result(self) -> list[float | None]:
        out: list[float | None] = []
        for q in self.fractions:
            if not self.n:
                out.append(None)
                continue
            at = q * (self.n - 1)
            low, high = math.floor(at), math.ceil(at)
            a, b = self.known[low], self.known[high]
            out.append(a if low == high or a == b else (high - at) * a + (at - low) * b)
        return out


def _near(shares: Sequence[float]) -> Column:
    return F.array(*(F.lit(min(max(s + d, 0.0), 1.0)) for s in shares for d in (-REACH, REACH)))


def _begin(df: DataFrame, columns: list[_Column]) -> None:
    parts = []
    for i, c in enumerate(columns):
        v = F.when(~F.isnan(c.value), c.value)
        sketch = F.percentile_approx(v, _near(c.fractions), ACCURACY)
        parts += [F.count_if(F.isnan(c.value)).alias(f"{i}_nan"), F.count(c.value).alias(f"{i}_n"), F.min(v).alias(f"{i}_a"), F.max(v).alias(f"{i}_b"), sketch.alias(f"{i}_s")]
    row = df.agg(*parts).first()
    for i, c in enumerate(columns):
        c.start(*(row[f"{i}_{x}"] for x in ("nan", "n", "a", "b")), row[f"{i}_s"] or [0.0] * (2 * len(c.fractions)))


def _propose(df: DataFrame, columns: list[_Column]) -> None:
    """Narrower intervals around the ranks that are still unknown."""
    shares = [(c, i, x) for c in columns for i, x in c.shares().items()]
    sketches = (F.percentile_approx(F.when(c.between(i), c.value), _near([s for _, s in x]), ACCURACY).alias(str(k)) for k, (c, i, x) in enumerate(shares))
    row = df.agg(*sketches).first()
    for k, (c, _, x) in enumerate(shares):
        for (rank, _), a, b in zip(x, row[k][::2], row[k][1::2], strict=True):
            c._ask(rank, a, b)


def _values(df: DataFrame, columns: list[_Column]) -> list[list[tuple[float, int]]] | None:
    """The distinct values of the intervals and their counts by column; None where they are too many."""
    held = [reduce(Column.__or__, map(c.between, c.intervals())) if c.asked else F.lit(False) for c in columns]
    cells = F.array(*(F.when(h, F.struct(F.lit(i).alias("c"), c.value.alias("v"))) for i, (c, h) in enumerate(zip(columns, held, strict=True))))
    few = df.where(reduce(Column.__or__, held)).select(F.explode(cells).alias("x")).where("x is not null")
    rows = few.groupBy("x.c", "x.v").agg(F.count("*").alias("n")).limit(4 * LEFT).collect()
    if len(rows) >= 4 * LEFT:
        return None
    out: list[list[tuple[float, int]]] = [[] for _ in columns]
    for r in sorted(rows):
        out[r["c"]].append((r["v"], r["n"]))
    return out


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], left: int = LEFT) -> dict[str, list[float | None]]:
    """The exact quantiles of each column at its fractions, linear between order statistics; None without values.

    ``left`` bounds the rows that the last round looks at one by one. ``df`` is read three times or more: keep what is costly.
    """
    columns = [_Column(c, q) for c, q in wanted.items()]
    if columns:
        _begin(df, columns)
    while any(c.within for c in columns):
        if not any(c.asked for c in columns):
            _propose(df, columns)
        values = _values(df, columns) if sum(c.left() for c in columns) <= left else None
        ends = [(c, i) for c in columns for i in c.intervals()]
        parts = []
        for k, (c, i) in enumerate(ends):
            parts.append(F.count_if(c.value < i[0]).alias(f"{k}_under"))
            parts += [F.count_if(c.value <= i[1]).alias(f"{k}_most")] if values is None else []
        row = df.agg(*parts).first().asDict()
        for j, c in enumerate(columns):
            c.place({i: (row[f"{k}_under"], row.get(f"{k}_most")) for k, (d, i) in enumerate(ends) if d is c}, values[j] if values else [])
    return {c.name: c.result() for c in columns}
