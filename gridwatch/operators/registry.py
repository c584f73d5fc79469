"""The run table: parameters, metrics and tags of training runs, and which run is active."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.once import create_once, listed, read_text
from .boosting import Forest, Tree

RUNS = "run_id string, run_name string, start_time timestamp_ntz, params map<string,string>, metrics map<string,double>, tags map<string,string>, promoted boolean"


def append_run(runs_path: str, runs: DataFrame) -> None:
    runs.write.mode("append").parquet(runs_path)


def latest_promoted(runs: DataFrame, metric: str = "brier", default: float = 0.0623) -> DataFrame:
    """One row: the metric of the promoted run that started last, or the default where none is."""
    last = runs.where("promoted").orderBy(F.desc("start_time"), F.desc("run_id")).limit(1).select("run_id", F.col("metrics")[metric].alias("value"))
    return last.agg(F.max("run_id").alias("run_id"), F.coalesce(F.max("value"), F.lit(default)).alias(metric))


def promotion(challengers: DataFrame, champion: DataFrame, metric: str = "brier") -> DataFrame:
    """A challenger is promoted if its metric is smaller than the champion's (equal isn't enough)."""
    c = champion.select(F.col(metric).alias("champion_value"))
    value = F.col("metrics")[metric]
    return challengers.crossJoin(F.broadcast(c)).select("run_id", value.alias("challenger_value"), "champion_value", F.coalesce(value < F.col("champion_value"), F.lit(False)).alias("promote"))


def active_pointer(decisions: DataFrame, at: Column) -> DataFrame:
    """The pointer row that makes the best promoted run active; artefacts stay where they are."""
    best = decisions.where("promote").orderBy("challenger_value", "run_id").limit(1)
    return best.select(F.col("run_id").alias("active_run_id"), at.alias("since"))


class Active:
    """Which run is active, as numbered versions in a folder: a change takes the next number, which only one writer gets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in listed(self.spark, self.path) if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def read(self) -> tuple[int, str | None]:
        """The last version and its run; version 0 without a run before the first change."""
        versions = self._versions()
        if not versions:
            return 0, None
        return versions[-1], json.loads(read_text(self.spark, f"{self.path}/{versions[-1]:010d}.json"))["run_id"]

    def swap(self, run_id: str, version: int) -> bool:
        """Make ``run_id`` active if ``version`` is still the last; False where another writer was first."""
        if self._versions()[-1:] != ([version] if version else []):
            return False
        return create_once(self.spark, f"{self.path}/{version + 1:010d}.json", json.dumps({"run_id": run_id, "after": version}))


_NODES = "tree int, node int, feature int, cut double, left int, right int, value double, cover double, base double, features array<string>"


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """A forest as a table of its nodes; a forest without trees is one row without a tree."""
    rows = [(i, n, *x, forest.base, forest.features) for i, t in enumerate(forest.trees) for n, x in enumerate(zip(t.feature, t.cut, t.left, t.right, t.value, t.cover, strict=True))]
    spark.createDataFrame(rows or [(None,) * 8 + (forest.base, forest.features)], _NODES).coalesce(1).write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> Forest:
    nodes = spark.read.schema(_NODES).parquet(path).orderBy("tree", "node").collect()  # bounded by the rounds and the depth
    trees = [Tree() for _ in range(max((r["tree"] for r in nodes if r["tree"] is not None), default=-1) + 1)]
    for r in nodes:
        if r["tree"] is not None:
            t = trees[r["tree"]]
            for column in ("feature", "cut", "left", "right", "value", "cover"):
                getattr(t, column).append(r[column])
    return Forest(nodes[0]["features"], nodes[0]["base"], trees)
