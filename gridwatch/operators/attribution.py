"""Additive attributions of a fitted model by sampled permutations, and what they say about features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attributions(score: Callable[[DataFrame], DataFrame], rows: DataFrame, background: DataFrame, features: list[str], key: str, permutations: int = 4, value: str = "prob_raw", seed: int = 5) -> DataFrame:
    """``key, feature, value, attribution``: the mean change of the score when a feature turns from a background row's to the row's own value.

    Each row and permutation meets one background row (picked by hash) and is scored with 0 to all features turned,
    in the permutation's order, so the attributions of a row add up to its score less the background's.
    ``score`` adds the column ``value``; ``rows`` and ``background`` are the samples to explain and to compare with.
    """
    k = len(features)
    bg = background.select(*(F.col(f).alias(f"_b_{f}") for f in features))
    n = max(background.count(), 1)
    from pyspark.sql import Window as W

    # the background is a bounded sample: number its rows
    bg = bg.withColumn("_bg", F.row_number().over(W.orderBy(*(f"_b_{f}" for f in features))) - 1)
    many = rows.select(key, *features).withColumn("_perm", F.explode(F.array(*(F.lit(i) for i in range(permutations)))))
    many = many.withColumn("_bg", F.pmod(F.xxhash64(key, "_perm", F.lit(seed)), F.lit(n)).cast("int")).join(F.broadcast(bg), "_bg")
    order = F.array_sort(F.array(*(F.struct(F.xxhash64(key, "_perm", F.lit(f), F.lit(seed)).alias("h"), F.lit(f).alias("f")) for f in features)))
    many = many.withColumn("_order", F.transform(order, lambda s: s["f"]))
    steps = many.withColumn("_step", F.explode(F.array(*(F.lit(i) for i in range(k + 1)))))
    turned = {f: F.when(F.array_position("_order", F.lit(f)) <= F.col("_step"), F.col(f)).otherwise(F.col(f"_b_{f}")) for f in features}
    scored = score(steps.select(key, "_perm", "_step", "_order", *(F.col(f).alias(f"_v_{f}") for f in features), *(turned[f].alias(f) for f in features)))
    by_step = scored.groupBy(key, "_perm").agg(F.map_from_entries(F.collect_list(F.struct("_step", value))).alias("_s"), F.first("_order").alias("_order"), *(F.first(f"_v_{f}").alias(f) for f in features))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("c")
    long = by_step.select(key, "_s", "_order", cells)
    at = F.array_position("_order", F.col("c.feature")).cast("int")
    return long.select(key, "c.feature", "c.value", (F.col("_s")[at] - F.col("_s")[at - 1]).alias("d")).groupBy(key, "feature").agg(F.first("value").alias("value"), F.avg("d").alias("attribution"))


def mean_absolute(found: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Mean absolute attribution by feature, or by category (sum of its features' means), largest first."""
    by = found.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    if not categories:
        return by.orderBy(F.desc("mean_abs"), "feature")
    c = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))
    return by.groupBy(c[F.col("feature")].alias("category")).agg(F.sum("mean_abs").alias("mean_abs")).orderBy(F.desc("mean_abs"), "category")


def step_up(found: DataFrame, feature: str, cut: float, bins: int = 24, least: float = 0.01) -> DataFrame:
    """Mean of binned attributions above ``cut`` less that below it, and whether the step is confirmed."""
    own = found.where(F.col("feature") == feature)
    ends = own.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = own.crossJoin(F.broadcast(ends)).where("value < hi").withColumn("bin", F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    means = placed.groupBy("bin", "lo", "hi").agg(F.avg("attribution").alias("m"))
    middle = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    step = F.avg(F.when(middle >= cut, F.col("m"))) - F.avg(F.when(middle < cut, F.col("m")))
    return means.agg(step.alias("step")).withColumn("confirmed", F.coalesce(F.col("step") > least, F.lit(False)))


def bias_ratio(found: DataFrame, strong: list[str], calendar: list[str], least: float = 2.0) -> DataFrame:
    """Mean of the strong features' mean absolute attributions over the largest calendar one."""
    by = mean_absolute(found)
    ratio = F.avg(F.when(F.col("feature").isin(*strong), F.col("mean_abs"))) / (F.max(F.when(F.col("feature").isin(*calendar), F.col("mean_abs"))) + 1e-8)
    return by.agg(ratio.alias("ratio")).withColumn("passes", F.coalesce(F.col("ratio") > least, F.lit(False)))


def interaction_table(found: DataFrame, feature: str, other: str, key: str) -> DataFrame:
    a = found.where(F.col("feature") == feature).select(key, F.col("value").alias(feature), "attribution")
    return a.join(found.where(F.col("feature") == other).select(key, F.col("value").alias(other)), key)


def local_explanation(found: DataFrame, scored: DataFrame, key: str, label: str, value: str = "prob_raw", sure: float = 0.7, n: int = 15) -> DataFrame:
    """The ``n`` largest attributions of the first positive scored above ``sure``, else of the first positive."""
    first = scored.where(F.col(label) == 1).orderBy(F.desc((F.col(value) > sure).cast("int")), key).limit(1).select(key)
    return found.join(F.broadcast(first), key).orderBy(F.desc(F.abs("attribution")), "feature").limit(n)
