"""Reading and writing the panel's files: CSV by name or position, yearly files, date-keyed Parquet, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import no_nan
from ..operators.timegrid import parse_day_first
from .once import listed

# Ordinals of the settlement export's columns and their names.
SETTLEMENT = {0: "timestamp", 6: "pos_sec_vol_kwh", 7: "neg_sec_vol_kwh", 12: "CH_DE_kwh", 13: "DE_CH_kwh", 14: "CH_FR_kwh", 15: "FR_CH_kwh", 21: "pos_sec_price", 22: "neg_sec_price"}


def read_csv(spark: SparkSession, path: str | list[str], schema: str, names: list[str] | None = None) -> DataFrame:
    """CSV with a header under a declared schema; ``names`` rename by position. NaN becomes null."""
    df = spark.read.csv(path, header=True, schema=schema)
    df = df.toDF(*names) if names else df
    return df.select(*(no_nan(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def read_sheet(spark: SparkSession, paths: list[str], columns: dict[int, str] | None = None, ts: str = "timestamp") -> DataFrame:
    """Delimited exports of sheets: columns by ordinal, times day first. Heading lines (no time in the first column) go."""
    columns = columns or SETTLEMENT
    raw = [spark.read.csv(p, header=False) for p in paths]
    picked = [r.select(*(F.col(f"_c{i}").alias(n) for i, n in columns.items())) for r in raw]
    both = parse_day_first(union_all(picked), ts, "_ts").where("_ts is not null")
    return both.select(F.col("_ts").alias(ts), *(F.expr(f"try_cast({n} as double)").alias(n) for n in columns.values() if n != ts))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def year_or_latest(df: DataFrame, year: int, column: str = "year") -> DataFrame:
    """Rows of ``year`` or, if there are none, of the latest year; both are partition filters."""
    found = [r[0] for r in df.select(column).distinct().collect()]  # a row for each yearly file
    if not found:
        return df
    return df.where(F.col(column) == (year if year in found else max(found)))


def write_dated(df: DataFrame, path: str, ts: str = "ts", date: str = "date") -> None:
    """Parquet by date; a rerun replaces only the dates it holds."""
    dated = df if date in df.columns else df.withColumn(date, F.to_date(ts))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def read_dated(spark: SparkSession, path: str, day: str | None = None, date: str = "date") -> DataFrame:
    df = spark.read.parquet(path)
    return df if day is None else df.where(F.col(date) == F.lit(day).cast("date"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def assembled(grid: DataFrame, feeds: dict[str, DataFrame], wanted: list[str], ts: str = "ts") -> DataFrame:
    """The grid with one column for each feed ``(ts, value)``; a feed that's absent is a column of nulls."""
    out = reduce(lambda g, kv: g.join(kv[1].select(ts, F.col("value").alias(kv[0])), ts, "left"), feeds.items(), grid)
    return out.select(ts, *(F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in wanted))


def load_model(spark: SparkSession, path: str) -> PipelineModel | DataFrame:
    """What ``save_model`` wrote: a pipeline, or a table of nodes."""
    return PipelineModel.load(path) if "metadata" in listed(spark, path) else spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """A fitted pipeline, or a forest's node table."""
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)
