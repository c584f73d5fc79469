"""Regular time grids, alignment onto them, gaps, duplicates and time zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Minutes of a slot; it divides an hour.
STEP = 15


def grid(spark: SparkSession, start: str, stop: str, step: int = STEP) -> DataFrame:
    """``ts`` from ``start`` to ``stop``, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"interval {step} minutes"))).alias("ts"))


def grid_of(df: DataFrame, ts: str = "ts", step: int = STEP, series: tuple[str, ...] = ()) -> DataFrame:
    """The grid of each series from its first to its last slot, dealt out by day."""
    unit = F.expr(f"interval {step} minutes")
    ends = df.groupBy(*series).agg(F.min(slot(ts, step)).alias("_a"), F.max(slot(ts, step)).alias("_z"))
    days = ends.where("_a is not null").select(*series, "_a", "_z", F.explode(F.sequence(F.date_trunc("day", "_a"), F.date_trunc("day", "_z"), F.expr("interval 1 day"))).alias("_d"))
    day = F.col("_d").cast("timestamp_ntz")
    slots = F.sequence(F.greatest("_a", day), F.least("_z", day + F.expr("interval 1 day") - unit), unit)
    # a day's first slot is on the grid, as the step divides a day
    return days.select(*series, F.explode(slots).alias(ts))


def slot(ts: str = "ts", step: int = STEP) -> Column:
    """The start of the slot that a time is in."""
    return F.expr(f"{ts} - make_dt_interval(0, 0, minute({ts}) % {step}, extract(SECOND FROM {ts}))")


def as_of(left: DataFrame, right: DataFrame, values: list[str], ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time; a null value isn't skipped.

    One union and one window for each series and day: the last row of earlier days is carried over from a scan of
    one row for each day, so no series meets in one task as a whole.
    """
    payload = F.struct(*(F.col(c) for c in values))
    r = right.select(*series, ts, payload.alias("_p")).withColumn("_left", F.lit(0))
    l_ = left.withColumn("_p", F.lit(None).cast(r.schema["_p"].dataType)).withColumn("_left", F.lit(1))
    both = l_.unionByName(r, allowMissingColumns=True).withColumn("_b", F.date_trunc("day", ts))
    ends = both.groupBy(*series, "_b").agg(F.max_by("_p", F.when(F.col("_left") == 0, F.col(ts))).alias("_e"))
    scan = W.partitionBy(*(series or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*series, "_b", F.last("_e", ignorenulls=True).over(scan).alias("_c"))
    own = W.partitionBy(*series, "_b").orderBy(ts, "_left").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_p", F.last("_p", ignorenulls=True).over(own)).where("_left = 1").join(carry, [*series, "_b"])
    out = out.withColumn("_p", F.coalesce("_p", "_c"))
    keep = [c for c in left.columns if c not in values]
    return out.select(*keep, *(F.col(f"_p.{c}").alias(c) for c in values))


def to_local(df: DataFrame, zone: str, ts: str = "ts") -> DataFrame:
    """UTC times as wall-clock times of a zone; the hour after summer time ends comes twice."""
    return df.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts).cast("timestamp_ntz")))


def first_of_each(df: DataFrame, by: str, order: list[str], series: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with the same series and ``by``, the first in ``order``."""
    rank = F.row_number().over(W.partitionBy(*series, by).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def parse_day_first(df: DataFrame, column: str, to: str = "ts", pattern: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """Times written day first; texts that aren't times are null."""
    return df.withColumn(to, F.expr(f"try_to_timestamp({column}, '{pattern}')").cast("timestamp_ntz"))


def modal_step(df: DataFrame, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent step in seconds between neighbouring rows and its count; ties: the smaller step."""
    from .blocks import windowed

    steps = windowed(df.select(*series, ts), lambda w: {"_p": F.lag(ts).over(w)}, 1, ts, series)
    seconds = F.expr(f"timestampdiff(SECOND, _p, {ts})").alias("step_seconds")
    return steps.where("_p is not null").select(seconds).groupBy("step_seconds").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step_seconds").limit(1)


def hourly_mean(df: DataFrame, columns: list[str], ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """Means by hour; hours whose key columns are all without values go."""
    out = df.groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias(ts)).agg(*(F.avg(c).alias(c) for c in columns))
    return out.dropna(subset=list(keys)) if keys else out


def month_mean(df: DataFrame, column: str, day: str = "day") -> DataFrame:
    """Mean by calendar month, labelled with the month's last day."""
    return df.groupBy(F.last_day(day).alias("month_end")).agg(F.avg(column).alias(column))


def between_with_buffer(df: DataFrame, day: str, ts: str = "ts", before: str = "1 hour", step: int = STEP) -> DataFrame:
    """One day and ``before`` ahead of it; the bounds are constants, so they reach the scan."""
    start = F.lit(day).cast("timestamp_ntz")
    return df.where((F.col(ts) >= start - F.expr(f"interval {before}")) & (F.col(ts) <= start + F.expr("interval 1 day") - F.expr(f"interval {step} minutes")))


def one_day(df: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    return df.where(F.to_date(ts) == F.lit(day).cast("date"))


def history_for_day(df: DataFrame, day: str, halo: str, ts: str = "ts") -> DataFrame:
    """The day and the ``halo`` of history its features look back on: filter before the windows, ``one_day`` after them."""
    start = F.lit(day).cast("timestamp_ntz")
    return df.where((F.col(ts) >= start - F.expr(f"interval {halo}")) & (F.col(ts) < start + F.expr("interval 1 day")))


def missing_slots(df: DataFrame, ts: str = "ts", step: int = STEP, series: tuple[str, ...] = ()) -> DataFrame:
    """Slots of the grid that no row is in."""
    present = df.select(*series, slot(ts, step).alias(ts)).distinct()
    return grid_of(present, ts, step, series).join(present, [*series, ts], "left_anti")
