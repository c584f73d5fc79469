"""Profiles, coverage, comparisons of tables, and labels from quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from .selection import quantiles

QUARTILES = (0.25, 0.5, 0.75)


def unpivoted(one: DataFrame, columns: list[str], parts: dict[str, str]) -> DataFrame:
    """A row for each of ``columns`` from a one-row table whose cells are named ``<part>__<column>``."""
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{p}__{c}").cast(t).alias(p) for p, t in parts.items())) for c in columns))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def _each(df: DataFrame, columns: list[str], make: dict[str, tuple]) -> DataFrame:
    one = df.agg(*(f(c).alias(f"{p}__{c}") for c in columns for p, (f, _) in make.items()))
    return unpivoted(one, columns, {p: t for p, (_, t) in make.items()})


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of each column."""
    cut = quantiles(df, dict.fromkeys(columns, QUARTILES))
    make = {"n": (F.count, "bigint"), "mean": (F.avg, "double"), "std": (F.stddev_samp, "double"), "min": (F.min, "double")}
    make |= {f"p{int(100 * q)}": ((lambda c, i=i: F.first(F.lit(cut[c][i]).cast("double"))), "double") for i, q in enumerate(QUARTILES)}
    return _each(df, columns, make | {"max": (F.max, "double")})


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-null rows of each column in percent and its status: good over 95, fair over 80, else poor."""
    out = _each(df, columns, {"coverage": (lambda c: F.avg(F.col(c).isNotNull().cast("int")) * 100, "double")})
    return out.withColumn("status", F.when(F.col("coverage") > 95, "good").when(F.col("coverage") > 80, "fair").otherwise("poor"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    out = _each(df, columns, {"n_null": (lambda c: F.count_if(F.col(c).isNull()), "bigint"), "n": (lambda c: F.count(F.lit(1)), "bigint")})
    return out.withColumn("pct_null", F.col("n_null") / F.col("n") * 100)


def by_category(df: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Mean, deviation and null share of each feature, with its category."""
    make = {"mean": (F.avg, "double"), "std": (F.stddev_samp, "double"), "pct_null": (lambda c: F.avg(F.col(c).isNull().cast("int")) * 100, "double")}
    out = _each(df, list(categories), make)
    category = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))
    return out.withColumn("category", category[F.col("column_name")])


def rate_gap(a: DataFrame, b: DataFrame, event: Column) -> DataFrame:
    """Rates of ``event`` in two tables in percent, and whether their gap is small (under 5), fair (under 10) or large."""
    one = a.agg((F.avg(event.cast("int")) * 100).alias("rate_a")).crossJoin(b.agg((F.avg(event.cast("int")) * 100).alias("rate_b")))
    gap = F.abs(F.col("rate_a") - F.col("rate_b"))
    return one.withColumn("gap", gap).withColumn("status", F.when(gap < 5, "small").when(gap < 10, "fair").otherwise("large"))


def range_overlap(train: DataFrame, later: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time of two tables, and whether the later one begins before the first one ends."""
    a = train.agg(F.min(ts).alias("train_min"), F.max(ts).alias("train_max"))
    return a.crossJoin(later.agg(F.min(ts).alias("val_min"), F.max(ts).alias("val_max"))).withColumn("overlap", F.col("val_min") <= F.col("train_max"))


def fixed_label(df: DataFrame, source: DataFrame, value: str, q: float = 0.9, to: str = "price_spike") -> DataFrame:
    """``to``: 1 above the quantile that ``value`` has in ``source`` (a training split: no look-ahead); the threshold stays as a column."""
    (cut,) = quantiles(source, {value: [q]})[value]
    return df.withColumn("spike_threshold", F.lit(cut).cast("double")).withColumn(to, flag(F.col(value) > F.col("spike_threshold")))


def threshold_label(value: str, cut: float) -> Column:
    return flag(F.col(value) > cut)


def year_split(df: DataFrame, year: int, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to the end of ``year``, and those of the year after."""
    return df.where(F.year(ts) <= year), df.where(F.year(ts) == year + 1)


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column take its exact median."""
    cut = quantiles(df, dict.fromkeys(columns, [0.5]))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(cut[c][0]).cast("double")) for c in columns})


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed whatever the partitioning."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
