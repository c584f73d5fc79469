"""Column expressions of the panel: null-safe clipping, flags, sums, energy and time parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(c: Column | str) -> Column:
    """Null for NaN: comparisons and aggregates in the engine then skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """``c`` held between bounds; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sum_available(df: DataFrame, names: list[str]) -> Column:
    """Sum over those of ``names`` that the table has, nulls skipped (all null: 0)."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in names if c in df.columns), F.lit(0.0))


def energy_to_power(df: DataFrame, suffix: str = "_kwh", to: str = "_mw", per_hour: int = 4) -> DataFrame:
    """Interval energy in kWh columns as mean power in MW; the energy columns go."""
    found = [c for c in df.columns if c.endswith(suffix)]
    return df.withColumns({c[: -len(suffix)] + to: F.col(c) * per_hour / 1000 for c in found}).drop(*found)


def time_parts(df: DataFrame, ts: str = "ts", turnover: tuple[int, ...] = (0, 45)) -> DataFrame:
    """``hour``, ``minute``, ``hh_mm`` and ``is_turnover`` (minutes at which schedules change)."""
    return df.withColumns(
        {
            "hour": F.hour(ts).cast("int"),
            "minute": F.minute(ts).cast("int"),
            "hh_mm": (F.hour(ts) * 100 + F.minute(ts)).cast("int"),
            "is_turnover": flag(F.minute(ts).isin(*turnover)),
        }
    )


def conform(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    """The columns of ``spec`` (name, type) in order; columns the table lacks are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in spec))


def month_label(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")
