"""Ordered operators over long series without an unpartitioned window.

Rows get an index from the counts of their time buckets (a small table) and their place within the bucket.
Blocks of consecutive rows then carry the last ``halo`` rows of the block before, so that a window of up to
``halo`` rows back is exact inside a block; carried rows are dropped again. Cumulative operators take two passes:
a summary of each bucket, a scan of the summaries, and the bucket's own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def indexed(df: DataFrame, ts: str = "ts", series: tuple[str, ...] = (), then: tuple[str, ...] = (), bucket: str = "day") -> DataFrame:
    """``df`` with ``idx``: the position of a row in its series by ``ts`` and ``then``, from 0."""
    b = df.withColumn("_b", F.date_trunc(bucket, F.col(ts).cast("timestamp_ntz")))
    counts = b.groupBy(*series, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*(series or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    starts = counts.withColumn("_start", before).drop("_n")
    own = F.row_number().over(W.partitionBy(*series, "_b").orderBy(ts, *then))
    return b.join(starts, [*series, "_b"]).withColumn("idx", F.col("_start") + own - 1).drop("_b", "_start")


def windowed(df: DataFrame, add: Callable[[WindowSpec], dict[str, Column]], halo: int, ts: str = "ts", series: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """``df`` with the columns that ``add`` makes of a window ordered by row index; it may look back ``halo`` rows."""
    out = _haloed(df if "idx" in df.columns else indexed(df, ts, series), halo, block)
    out = out.withColumns(add(W.partitionBy(*series, "_blk").orderBy("idx")))
    return out.where(F.col("_own")).drop("_blk", "_own")


def _haloed(df: DataFrame, halo: int, block: int | None) -> DataFrame:
    size = block or max(4 * halo, 4096)
    out = df.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("idx") / size), F.floor((F.col("idx") + halo) / size))))
    return out.withColumn("_own", F.floor(F.col("idx") / size) == F.col("_blk"))


def filled_forward(df: DataFrame, columns: list[str], ts: str = "ts", series: tuple[str, ...] = (), bucket: str = "day") -> DataFrame:
    """Nulls of ``columns`` take the last value before them in their series."""
    b = df.withColumn("_b", F.date_trunc(bucket, F.col(ts).cast("timestamp_ntz")))
    ends = b.groupBy(*series, "_b").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_{c}") for c in columns))
    scan = W.partitionBy(*(series or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*series, "_b", *(F.last(f"_{c}", ignorenulls=True).over(scan).alias(f"_{c}") for c in columns))
    own = W.partitionBy(*series, "_b").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    out = b.join(carry, [*series, "_b"])
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"_{c}")) for c in columns}).drop("_b", *(f"_{c}" for c in columns))


def running_sum(df: DataFrame, value: Column, name: str, ts: str = "ts", series: tuple[str, ...] = (), bucket: str = "day", then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over a row and all before it in its series."""
    b = df.withColumn("_b", F.date_trunc(bucket, F.col(ts).cast("timestamp_ntz"))).withColumn("_v", value)
    sums = b.groupBy(*series, "_b").agg(F.sum("_v").alias("_s"))
    scan = W.partitionBy(*(series or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*series, "_b", F.coalesce(F.sum("_s").over(scan), F.lit(0)).alias("_c"))
    own = W.partitionBy(*series, "_b").orderBy(ts, *then).rowsBetween(W.unboundedPreceding, 0)
    return b.join(carry, [*series, "_b"]).withColumn(name, F.coalesce(F.sum("_v").over(own), F.lit(0)) + F.col("_c")).drop("_b", "_v", "_c")
