"""The stream-safe operators on Structured Streaming: rules row by row, windows and episodes under a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quality import Rule


def flagged_rows(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each row with the indices of the rules it breaks (``broken``); rows that break none go."""
    hits = F.filter(F.array(*(F.when(r.broken(), F.lit(i)) for i, r in enumerate(rules))), lambda x: x.isNotNull())
    return stream.withColumn("broken", hits).where(F.size("broken") > 0)


def rows_by_window(stream: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "n")


def window_means(stream: DataFrame, columns: list[str], ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(*(F.avg(c).alias(c) for c in columns))
    return out.select(F.col("window.start").alias("start"), *columns)


def episode_stream(stream: DataFrame, hit: Column, price: str, series: list[str], ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours", step_minutes: int = 15) -> DataFrame:
    """Episodes of each series as session windows; a session ends ``gap`` after its last row, so that much is taken off again."""
    s = stream.where(hit).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *series).agg(F.count("*").alias("n_intervals"), F.max(price).alias("peak_price"), F.avg(price).alias("mean_price"))
    end = F.col("session_window.end") - F.expr(f"interval {gap}")
    minutes = (F.timestamp_diff("MINUTE", F.col("session_window.start"), end) + step_minutes).cast("int")
    return s.select(*series, F.col("session_window.start").alias("start_ts"), end.alias("end_ts"), "n_intervals", "peak_price", "mean_price", minutes.alias("duration_min"))


def without_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def batch_writer(predict: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's predictions into the folder of its number: a batch that is replayed replaces its rows."""

    def one(batch: DataFrame, number: int) -> None:
        predict(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return one


def scored_to(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str] | None = None, ts: str = "ts", late: str = "1 day"):
    """Write each micro-batch's predictions as Parquet, once also after a failure; started by the caller's trigger. Rows of equal
    ``keys`` within ``late`` are scored once."""
    rows = without_repeats(stream, keys, ts, late) if keys else stream
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_writer(predict, path))
