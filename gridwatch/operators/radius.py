"""A radius index: rows of a metric space dealt to cells so that all neighbours within a radius meet in one cell.

Every row is a member of one cell and a visitor of others. A cell with many members is split by reference points
taken from it: a member goes to the nearest, and a row visits every other cell whose reference point is at most twice
the radius farther than its nearest. By the triangle inequality no row within the radius can have its home elsewhere. A
visit also ends where the row is farther from the reference point than the cell's farthest member plus the radius. Cells are
split again, with reference points of their own, while they are large and splitting takes work away: a row meets as
many points in each level, and levels grow with the logarithm of the rows. Vectors must be free of nulls and equally long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept

#: Members that a cell may have without being split, reference points of a split, and levels at most.
LEAF, FAN, LEVELS = 400, 24, 12
#: Rows of each side that a task holds the distances of.
BLOCK = 2000
#: A level is given up where its cells hold this many times the pairs of the level before.
WORTH = 0.9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def _dealt(radius: float):
    """Rows of split cells with a row for each new cell that they belong to or visit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for cell, part in f.groupby("cell"):
                points = np.stack([np.asarray(p) for p in part["points"].iloc[0]])
                d = distances(np.stack(part["v"].to_numpy()), points)
                near = d.argmin(axis=1)
                least = d[np.arange(len(d)), near]
                # rounding may move a distance by a little
                row, to = np.nonzero(d <= (least + 2 * radius)[:, None] * (1 + 1e-9) + 1e-9)
                x = part.iloc[row]
                out.append(pd.DataFrame({"cell": [f"{cell}.{t}" for t in to], "id": x["id"].to_numpy(), "v": x["v"].to_numpy(), "member": x["member"].to_numpy() & (near[row] == to), "d": d[row, to]}))
            if out:
                yield pd.concat(out)

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    one = F.col("member").cast("bigint")
    return rows.groupBy("cell").agg(F.sum(one).alias("members"), F.count("*").alias("n"), F.max(F.when(F.col("member"), F.col("d"))).alias("reach"))


def _visited(rows: DataFrame, radius: float) -> DataFrame:
    """Rows without the visits to cells without members, or too far from all of them; with the cell's size."""
    sized = rows.join(_sizes(rows), "cell")
    near = F.col("member") | ((F.col("members") > 0) & (F.col("d") <= (F.col("reach") + radius) * (1 + 1e-9) + 1e-9))
    return sized.where(near).drop("reach", "n")


def pairs(rows: DataFrame) -> float:
    """Distances that the cells ask for: members times rows, summed."""
    return _work(rows, "cell").agg(F.sum("work")).first()[0] or 0.0


def _work(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col("member").cast("double")) * F.count("*")).alias("work"))


def cells(df: DataFrame, key: str, vector: str, radius: float, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``cell, id, v, member``: each row once as a member, and as a visitor of each cell that may hold neighbours within ``radius``."""
    rows = df.select(F.lit("0").alias("cell"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(True).alias("member"), F.lit(0.0).alias("d"))
    rows = kept(rows.withColumn("members", F.lit(leaf + 1).cast("bigint")), "cells")
    done = []
    for _ in range(LEVELS):
        large = rows.where(F.col("members") > leaf)
        if not large.limit(1).count():
            break
        done.append(rows.where(F.col("members") <= leaf))
        slot = F.pmod(F.xxhash64("id", "cell"), F.lit(fan))
        picked = large.where("member").groupBy("cell", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(7)), "id", "v"))["v"].alias("v"))
        points = picked.groupBy("cell").agg(F.collect_list("v").alias("points"))  # at most ``fan`` points
        split = large.join(points, "cell").mapInPandas(_dealt(radius), "cell string, id bigint, v array<double>, member boolean, d double")
        split = kept(_visited(kept(split, "dealt"), radius), "visits").withColumn("parent", F.regexp_replace("cell", "[.][0-9]+$", ""))
        after = _work(split, "parent", "cell").groupBy("parent").agg(F.sum("work").alias("after"))
        worth = kept(after.join(_work(large, "cell").withColumnRenamed("cell", "parent"), "parent").where(F.col("after") <= WORTH * F.col("work")).select("parent"), "worth")
        # cells that splitting makes no smaller stay as they are
        done.append(large.join(worth.withColumnRenamed("parent", "cell"), "cell", "left_anti"))
        rows = split.join(worth, "parent", "left_semi").drop("parent")
    out = rows
    for x in done:
        out = out.unionByName(x)
    return kept(out.select("cell", "id", "v", "member"), "cells")


def in_cells(rows: DataFrame, found: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK, asks: str = "member") -> DataFrame:
    """``found(members, rows)`` of every cell, in blocks of about ``block`` rows of each side; a large cell is many groups.
    ``asks``: which rows are the members that are asked about; cells without any make no group."""
    size = rows.groupBy("cell").agg(F.ceil(F.sum(F.col(asks).cast("bigint")) / block).alias("mi"), F.ceil(F.count("*") / block).alias("mj")).where("mi > 0")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    sized = rows.join(size, "cell")
    left = sized.where(asks).withColumn("i", own("mi", 1)).withColumn("j", every("mj")).withColumn("side", F.lit(0))
    right = sized.withColumn("j", own("mj", 2)).withColumn("i", every("mi")).withColumn("side", F.lit(1))
    both = left.unionByName(right).drop("mi", "mj", "member", asks)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        p, q = part[part["side"] == 0], part[part["side"] == 1]
        return found(p, q) if len(p) and len(q) else found(part.iloc[:0], part.iloc[:0])

    return both.groupBy("cell", "i", "j").applyInPandas(run, schema)
