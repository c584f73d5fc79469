"""Episodes of consecutive flagged rows, their descriptions and samples of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import kept

from .windows import islands


def episodes(df: DataFrame, flag: str, price: str, columns: list[str], gap: str = "30 minutes", step_minutes: int = 15, least_minutes: int = 15, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """One row for each run of flagged rows no more than ``gap`` apart: start, end, rows, peak, means and maxima."""
    hits = islands(df.where(F.col(flag) == 1), gap, "event_id", ts, series)
    more = [a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}"))]
    out = hits.groupBy(*series, "event_id").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_intervals"), F.max(price).alias("peak_price"), F.avg(price).alias("mean_price"), *more)
    minutes = (F.timestamp_diff("MINUTE", F.col("start_ts"), F.col("end_ts")) + step_minutes).cast("int")
    return out.withColumn("duration_min", minutes).where(F.col("duration_min") >= least_minutes)


def whole(c: Column) -> Column:
    """A number rounded half to even, as text."""
    return F.bround(c, 0).cast("bigint").cast("string")


def _tier(c: Column, tiers: list[tuple[float, str]], other: str) -> Column:
    out = F.lit(other)
    for cut, name in reversed(tiers):
        out = F.when(c > cut, F.lit(name)).otherwise(out)
    return out


# The bounds above which each wording holds, largest first.
SEVERITY = [(5.0, "Extreme"), (3.0, "Severe"), (2.0, "Moderate")]
WIND = [(5000.0, "large German wind+solar forecast error of "), (2000.0, "moderate German forecast deviation of ")]
FLOW = [(1500.0, ("high unplanned cross-border flow averaging ", ", well above the 1250 MW grid bottleneck)")), (800.0, ("elevated unplanned flow averaging ", ", near the 1250 MW bottleneck)"))]
SPREAD = [(50.0, "large"), (10.0, "moderate")]


def described(events: DataFrame, threshold: str = "mean_threshold", wind: str = "mean_wind_error", flow: str = "abs_flow", spread: str = "mean_spread", load: str = "mean_load", pump: str = "mean_pump") -> DataFrame:
    """``description``: one paragraph on severity, length, cause and market context. Means absent from the table count as 0 (threshold: 200)."""
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in events.columns else F.lit(d)
    ratio = F.col("peak_price") / F.greatest(col(threshold, 200.0), F.lit(1.0))
    w, f, top, s, ld, pm = col(wind, 0.0), col(f"mean_{flow}", 0.0), col(f"max_{flow}", 0.0), col(spread, 0.0), col(load, 0.0), col(pump, 0.0)
    minutes = F.col("duration_min")
    length = F.when(minutes >= 120, "sustained ").when(minutes >= 45, "prolonged ").otherwise("brief ")
    flow_head = _tier(f, [(c, a) for c, (a, _) in FLOW], "low unplanned flow averaging ")
    flow_tail = _tier(f, [(c, b) for c, (_, b) in FLOW], ", below the bottleneck threshold)")
    demand = (
        F.when((ld > 8500) & (pm < 500), "during Swiss high demand with low pump generation").when(ld > 8500, "during Swiss high demand")
        .when(pm > 2000, "during high pump-storage activity").otherwise("during normal Swiss demand")
    )
    text = F.concat(
        _tier(ratio, SEVERITY, "Mild"), F.lit(" aFRR price spike: "), length, minutes.cast("string"), F.lit("-minute event, peak "), whole(F.col("peak_price")),
        F.lit(" EUR/MWh ("), F.format_string("%.1f", F.bround(ratio, 1)), F.lit("x threshold). Driven by "), _tier(F.abs(w), WIND, "small German forecast deviation of "), whole(w), F.lit(" MW and "),
        flow_head, whole(f), F.lit(" MW (peaking at "), whole(top), F.lit(" MW"), flow_tail, F.lit(". Market context: "), _tier(F.abs(s), SPREAD, "narrow"),
        F.lit(" day-ahead price spread DE-CH of "), whole(s), F.lit(" EUR/MWh, "), demand, F.lit("."),
    )
    return events.withColumn("description", text)


def cluster_samples(df: DataFrame, cluster: str, order: list[str], n: int = 5) -> DataFrame:
    """Up to ``n`` rows of each cluster at evenly spaced places, first and last included, with its size."""
    # ranges of rows in order: a large cluster takes many
    ranged = df.where(F.col(cluster) != -1).repartitionByRange(cluster, *order).withColumn("_range", F.spark_partition_id())
    ranged = kept(ranged, "ranges")
    counts = ranged.groupBy(cluster, "_range").agg(F.count("*").alias("_n"))
    w = W.partitionBy(cluster)
    before = F.sum("_n").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    sized = counts.withColumn("_before", before).withColumn("cluster_size", F.sum("_n").over(w))
    picks = F.array(*(F.floor(F.lit(i) * (F.col("cluster_size") - 1) / max(n - 1, 1)).cast("bigint") for i in range(n)))
    # only ranges that hold a wanted place are sorted
    wanted = sized.withColumn("_picks", F.filter(picks, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")))).where(F.size("_picks") > 0)
    placed = ranged.join(wanted.drop("_n"), [cluster, "_range"])
    placed = placed.withColumn("place", F.col("_before") + F.row_number().over(W.partitionBy(cluster, "_range").orderBy(*order)) - 1)
    return placed.where(F.array_contains("_picks", F.col("place"))).drop("_range", "_before", "_picks")


def cluster_summary(df: DataFrame, cluster: str, means: list[str]) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in means))


def compare_clusterings(labelled: dict[str, DataFrame], cluster: str = "cluster") -> DataFrame:
    """Points, clusters, noise and noise rate of several labellings."""
    out = None
    for name, df in labelled.items():
        noise = F.count_if(F.col(cluster) == -1)
        one = df.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("n_clusters"), noise.alias("n_noise")).select(F.lit(name).alias("model"), "*", (F.col("n_noise") / F.col("n")).alias("noise_rate"))
        out = one if out is None else out.unionByName(one)
    return out
