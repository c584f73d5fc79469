"""The ``events`` table as a 15-minute panel: purchases are the price, clicks less views the net flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import time_parts
from ..operators.aggregates import fixed_label
from ..operators.blocks import filled_forward
from ..operators.scratch import kept
from ..operators.timegrid import grid_of, slot

TYPES = {"price": "purchase", "flow_in": "click", "flow_out": "view", "sched": "signup", "upstream_error": "error"}
COLUMNS = list(TYPES)
_KEPT: dict[tuple[str, str | None, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts`` and the mean of each type of event in each slot; slots without events are null."""
    e = table(spark, sf_dir, "events").select(slot("ts").alias("ts"), "event_type", "value")
    means = e.groupBy("ts").agg(*(F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(c) for c, t in TYPES.items()))
    return grid_of(means).join(means, "ts", "left")


def filled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with gaps filled forward, one kept table for each source and session: what follows reads it several times."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf_dir)
    if key not in _KEPT:
        _KEPT[key] = kept(filled_forward(panel(spark, sf_dir), COLUMNS), "filled-panel")
    return _KEPT[key]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled panel with net and unplanned flow, interaction and time parts, rows without a price dropped."""
    p = filled_panel(spark, sf_dir)
    p = p.withColumn("net_flow", F.col("flow_in") - F.col("flow_out")).withColumn("unplanned", F.col("net_flow") - F.col("sched"))
    p = p.withColumn("abs_unplanned", F.abs("unplanned")).withColumn("interaction", F.col("unplanned") * F.col("sched"))
    return time_parts(p.na.drop(subset=["price", "unplanned"]))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features`` with a spike label above the 0.9 quantile of the first twenty days' prices."""
    f = features(spark, sf_dir)
    return fixed_label(f, f.where(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")), "price")


PANEL = """events_slot as (select ts - to_microseconds(epoch_us(ts) % 900000000) as ts, event_type, value from events),
means as (select ts, {means} from events_slot group by ts),
grid as (select unnest(generate_series(a, z, interval 15 minute)) as ts from (select min(ts) a, max(ts) z from means)),
panel as (select g.ts, {names} from grid g left join means using (ts))""".format(
    means=", ".join(f"avg(value) filter (event_type = '{t}') as {c}" for c, t in TYPES.items()), names=", ".join(COLUMNS)
)
FILLED = PANEL + ",\nfilled as (select ts, " + ", ".join(f"last_value({c} ignore nulls) over (order by ts rows between unbounded preceding and current row) as {c}" for c in COLUMNS) + " from panel)"
FEATURES = (
    FILLED
    + """,
flows as (select *, flow_in - flow_out as net_flow from filled),
features as (select *, abs(unplanned) as abs_unplanned, unplanned * sched as interaction, cast(hour(ts) as integer) as hour, cast(minute(ts) as integer) as minute,
  cast(hour(ts) * 100 + minute(ts) as integer) as hh_mm, case when minute(ts) in (0, 45) then 1 else 0 end as is_turnover
  from (select *, net_flow - sched as unplanned from flows) where price is not null and unplanned is not null)"""
)
LABELLED = (
    FEATURES
    + """,
cut as (select quantile_cont(price, 0.9) as spike_threshold from features where ts < timestamp '2024-01-21'),
labelled as (select f.*, spike_threshold, case when price > spike_threshold then 1 else 0 end as price_spike from features f, cut)"""
)
