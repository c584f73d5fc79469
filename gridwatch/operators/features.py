"""Panel features: net, scheduled and unplanned flows, reserves, and rows with what they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def net_flows(df: DataFrame, borders: dict[str, tuple[str, str]]) -> DataFrame:
    """``name = in - out`` for each border."""
    return df.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in borders.items()})


def unplanned_flows(df: DataFrame, pairs: dict[str, tuple[str, str]], total: str | None = None) -> DataFrame:
    """``name = actual - scheduled`` and its size ``abs_<name>`` for each pair; ``total`` adds the pairs up."""
    out = df.withColumns({n: F.col(a) - F.col(s) for n, (a, s) in pairs.items()})
    out = out.withColumns({f"abs_{n}": F.abs(n) for n in pairs})
    return out.withColumn(total, reduce(lambda a, b: a + b, (F.col(n) for n in pairs))) if total else out


def reserve_features(df: DataFrame, positive: str, negative: str) -> DataFrame:
    """Size of the negative reserve, and both together."""
    return df.withColumn("neg_reserve_abs", F.abs(negative)).withColumn("net_reserve", F.col(positive) + F.col(negative))


def products(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in pairs.items()})


def complete_rows(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls in ``keys``, and a one-row table of how many there are and how many went."""
    bad = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.where(~bad), df.agg(F.count_if(~bad).alias("n_kept"), F.count_if(bad).alias("n_dropped"))


def zipped(actual: DataFrame, forecast: DataFrame, origin: str, order: str) -> DataFrame:
    """The k-th forecast of an origin beside its k-th actual; what one side has more is dropped."""
    from pyspark.sql import Window as W

    step = F.row_number().over(W.partitionBy(origin).orderBy(order))
    a, b = actual.withColumn("step", step), forecast.withColumn("step", step).drop(order)
    return a.join(b, [origin, "step"])


def write_complete(df: DataFrame, keys: list[str], path: str) -> dict[str, int]:
    """Write the rows without nulls in ``keys`` as Parquet; ``n_kept`` and ``n_dropped`` are observed in the same job."""
    seen = Observation()
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    df.observe(seen, F.count_if(whole).alias("n_kept"), F.count_if(~whole).alias("n_dropped")).where(whole).write.parquet(path)
    return {k: seen.get[k] or 0 for k in ("n_kept", "n_dropped")}
