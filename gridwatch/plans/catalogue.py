"""Registered queries of the panel library and their SQL twins.

Doubles are rounded to six digits on both sides: engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip, energy_to_power, flag, month_label, sum_available
from ..operators import aggregates, binning, drift, events, metrics, quality, registry, stats, timegrid, windows
from ..operators import features as ft
from ..operators.quality import Field, Rule
from . import panel as pn

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, doubles: str = "", others: str = "") -> Callable[[Query], Query]:
    """Register a query, and its twin: ``sql`` gives the columns of ``others`` and those of ``doubles``."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            names = [*others.split(), *(f"round({c}, 6) + 0 as {c}" for c in doubles.split())]
            head, body = (f"with {sql.split(' ### ')[0]} ", sql.split(" ### ")[1]) if " ### " in sql else ("", sql)
            _SQL[f.__name__] = f"{head}select {', '.join(names)} from ({body}) q"
        return f

    return add


def queries() -> dict[str, Query]:
    from . import checks, models  # noqa: F401  register further queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import checks  # noqa: F401

    return dict(_SQL)


P = " ".join(pn.COLUMNS)
CUTS = " union all ".join


# Time grid


@query(f"{pn.PANEL} ### select * from panel", P, "ts")
def panel_15min(spark, d):
    return pn.panel(spark, d)


@query(f"{pn.FILLED} ### select * from filled", P, "ts")
def panel_ffill(spark, d):
    return pn.filled_panel(spark, d)


@query(f"{pn.PANEL}, own as (select distinct ts from events_slot where event_type = 'purchase') ### select unnest(generate_series(a, z, interval 15 minute)) as ts from (select min(ts) a, max(ts) z from own) except select ts from own", "", "ts")
def missing_slots(spark, d):
    e = pn.table(spark, d, "events").where("event_type = 'purchase'")
    return timegrid.missing_slots(e)


@query(f"{pn.PANEL} ### select g.ts, e.value, e.event_id from grid g asof left join (select * from events where event_type = 'purchase') e on g.ts >= e.ts", "value", "ts event_id")
def asof_latest_purchase(spark, d):
    e = pn.table(spark, d, "events")
    return timegrid.as_of(timegrid.grid_of(e.select("ts")), e.where("event_type = 'purchase'"), ["value", "event_id"])


@query(f"{pn.PANEL} ### select date_trunc('hour', ts) as ts, {', '.join(f'avg({c}) as {c}' for c in pn.COLUMNS)} from panel group by 1 having avg(price) is not null", P, "ts")
def hourly_mean(spark, d):
    return timegrid.hourly_mean(pn.panel(spark, d), pn.COLUMNS, keys=("price",))


@query("select epoch_us(ts - p) // 1000000 as step_seconds, count(*) as n from (select ts, lag(ts) over (order by ts) as p from events) where p is not null group by 1 order by n desc, 1 limit 1", "", "step_seconds n")
def modal_step(spark, d):
    return timegrid.modal_step(pn.table(spark, d, "events"))


@query("select (ts at time zone 'UTC') at time zone 'Europe/Zurich' as ts, event_id from events", "", "ts event_id")
def local_time(spark, d):
    return timegrid.to_local(pn.table(spark, d, "events").select("ts", "event_id"), "Europe/Zurich")


@query("select event_id, event_type, hour_ts, value from (select *, date_trunc('hour', ts) as hour_ts, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) as r from events) where r = 1", "value", "event_id event_type hour_ts")
def dedupe_first(spark, d):
    e = pn.table(spark, d, "events").withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return timegrid.first_of_each(e, "hour_ts", ["ts", "event_id"], ("event_type",)).select("event_id", "event_type", "hour_ts", "value")


@query("select last_day(day) as month_end, avg(total) as total from (select o_orderdate::date as day, sum(o_totalprice) as total from orders group by 1) group by 1", "total", "month_end")
def month_end_mean(spark, d):
    daily = pn.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return timegrid.month_mean(daily, "total")


@query("select event_id, ts from events where ts >= timestamp '2024-01-09 23:00:00' and ts <= timestamp '2024-01-10 23:45:00'", "", "event_id ts")
def day_with_buffer(spark, d):
    return timegrid.between_with_buffer(pn.table(spark, d, "events"), "2024-01-10").select("event_id", "ts")


@query("select o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') as text, date_trunc('minute', o_orderdate::timestamp) as ts from orders", "", "o_orderkey text ts")
def day_first_times(spark, d):
    text = pn.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy HH:mm").alias("text"))
    return timegrid.parse_day_first(text, "text")


# Projections and windows


@query(f"{pn.FEATURES} ### select * from features", f"{P} net_flow unplanned abs_unplanned interaction", "ts hour minute hh_mm is_turnover")
def panel_features(spark, d):
    return pn.features(spark, d)


@query(f"{pn.PANEL} ### select ts, coalesce(price, 0) + coalesce(sched, 0) + coalesce(flow_in, 0) as total, case when price < 50 then 50 when price > 90 then 90 else price end as clipped, case when price > 60 then 1 else 0 end as high, strftime(ts, '%Y-%m') as month from panel", "total clipped", "ts high month")
def projections(spark, d):
    p = pn.panel(spark, d)
    return p.select("ts", sum_available(p, ["price", "sched", "flow_in", "absent"]).alias("total"), clip("price", 50.0, 90.0).alias("clipped"), flag(F.col("price") > 60).alias("high"), month_label().alias("month"))


@query(f"{pn.FILLED} ### select ts, price, " + ", ".join(f"lag(price, {k}) over (order by ts) as price_lag{k}" for k in (1, 4, 96)) + ", lead(price, 2) over (order by ts) as price_lead2, price - lag(price) over (order by ts) as price_diff from filled", "price price_lag1 price_lag4 price_lag96 price_lead2 price_diff", "ts")
def lags_diffs(spark, d):
    p = pn.filled_panel(spark, d).select("ts", "price")
    return windows.difference(windows.shifted(p, "price", [1, 4, 96, -2]), "price").drop("idx")


def _frame(rows: int, current: bool) -> str:
    return f"(order by ts rows between {rows - 1 if current else rows} preceding and {'current row' if current else '1 preceding'})"


@query(f"{pn.FILLED} ### select ts, case when count(price) over {_frame(4, False)} = 4 then avg(price) over {_frame(4, False)} end as mean4 from filled", "mean4", "ts")
def rolling_mean4(spark, d):
    return windows.rolling(pn.filled_panel(spark, d).select("ts", "price"), "price", "mean", 4, "mean4", current=False).select("ts", "mean4")


@query(f"{pn.FILLED} ### select ts, case when count(price) over {_frame(96, True)} >= 48 then quantile_cont(price, 0.5) over {_frame(96, True)} end as median96 from filled", "median96", "ts")
def rolling_median96(spark, d):
    return windows.rolling(pn.filled_panel(spark, d).select("ts", "price"), "price", "median", 96, "median96", 48).select("ts", "median96")


@query(f"{pn.FILLED} ### select ts, case when count(price) over {_frame(96, True)} >= 48 then greatest(stddev_samp(price) over {_frame(96, True)}, 1.0) end as std96 from filled", "std96", "ts")
def rolling_std96(spark, d):
    out = windows.rolling(pn.filled_panel(spark, d).select("ts", "price"), "price", "std", 96, "std96", 48)
    return out.select("ts", clip("std96", low=1.0).alias("std96"))


@query(f"{pn.FILLED} ### select ts, case when count(price) over {_frame(2880, False)} >= 96 then quantile_cont(price, 0.9) over {_frame(2880, False)} end as p90 from filled", "p90", "ts")
def rolling_p90(spark, d):
    return windows.rolling_quantile(pn.filled_panel(spark, d).select("ts", "price"), "price", 0.9, 2880, "p90", 96).select("ts", "p90")


_Z = f"""{pn.FILLED},
t as (select ts, price, case when count(price) over {_frame(2880, False)} >= 96 then greatest(quantile_cont(price, 0.9) over {_frame(2880, False)}, 50.0) end as threshold,
 case when count(price) over {_frame(96, True)} >= 48 then quantile_cont(price, 0.5) over {_frame(96, True)} end as median96,
 case when count(price) over {_frame(96, True)} >= 48 then greatest(stddev_samp(price) over {_frame(96, True)}, 1.0) end as std96,
 {', '.join(f'lag(price, {k}) over (order by ts) as lag{k}' for k in (1, 4, 96))} from filled)"""


@query(f"{_Z} ### select ts, threshold, " + ", ".join(f"(lag{k} - median96) / std96 as price_delta_lag{k}, case when lag{k} / threshold > 2 then 2.0 else lag{k} / threshold end as price_vs_threshold_lag{k}, case when lag{k} > threshold then 1 else 0 end as price_above_lag{k}" for k in (1, 4, 96)) + " from t", "threshold " + " ".join(f"price_delta_lag{k} price_vs_threshold_lag{k}" for k in (1, 4, 96)), "ts " + " ".join(f"price_above_lag{k}" for k in (1, 4, 96)))
def zscore_lags(spark, d):
    out = windows.price_features(pn.filled_panel(spark, d).select("ts", "price"))
    return out.select("ts", "threshold", *(f"{n}_lag{k}" for k in (1, 4, 96) for n in ("price_delta", "price_vs_threshold", "price_above")))


# Aggregates, bins, statistics


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(CUTS(f"select '{c}' as column_name, count({c}) as n, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.75) as p75, max({c}) as max from lineitem" for c in _LINE), "mean std min p25 p50 p75 max", "column_name n")
def profile(spark, d):
    return aggregates.profile(pn.table(spark, d, "lineitem"), list(_LINE))


@query(f"{pn.PANEL} ### select *, case when coverage > 95 then 'good' when coverage > 80 then 'fair' else 'poor' end as status from (" + CUTS(f"select '{c}' as column_name, avg(({c} is not null)::int) * 100 as coverage from panel" for c in pn.COLUMNS) + ")", "coverage", "column_name status")
def coverage(spark, d):
    return aggregates.coverage(pn.panel(spark, d), pn.COLUMNS)


@query(f"{pn.PANEL} ### " + CUTS(f"select '{c}' as column_name, count(*) filter ({c} is null) as n_null, count(*) as n, 100.0 * count(*) filter ({c} is null) / count(*) as pct_null from panel" for c in pn.COLUMNS), "pct_null", "column_name n_null n")
def null_counts(spark, d):
    return aggregates.null_counts(pn.panel(spark, d), pn.COLUMNS)


_CATEGORY = {"price": "price", "flow_in": "flow", "flow_out": "flow", "sched": "schedule", "upstream_error": "error"}


@query(f"{pn.PANEL} ### " + CUTS(f"select '{c}' as column_name, avg({c}) as mean, stddev_samp({c}) as std, avg(({c} is null)::int) * 100 as pct_null, '{g}' as category from panel" for c, g in _CATEGORY.items()), "mean std pct_null", "column_name category")
def feature_summary(spark, d):
    return aggregates.by_category(pn.panel(spark, d), _CATEGORY)


_SPLIT = "date '1998-01-01'"


@query(f"select *, abs(rate_a - rate_b) as gap, case when abs(rate_a - rate_b) < 5 then 'small' when abs(rate_a - rate_b) < 10 then 'fair' else 'large' end as status from (select avg((l_discount > 0.05)::int) filter (l_shipdate < {_SPLIT}) * 100 as rate_a, avg((l_discount > 0.05)::int) filter (l_shipdate >= {_SPLIT}) * 100 as rate_b from lineitem)", "rate_a rate_b gap", "status")
def rate_gap(spark, d):
    t = pn.table(spark, d, "lineitem")
    return aggregates.rate_gap(t.where(F.expr(f"l_shipdate < {_SPLIT}")), t.where(F.expr(f"l_shipdate >= {_SPLIT}")), F.col("l_discount") > 0.05)


@query(f"{pn.FEATURES} ### select min(ts) filter (ts < timestamp '2024-01-21') as train_min, max(ts) filter (ts < timestamp '2024-01-21') as train_max, min(ts) filter (ts >= timestamp '2024-01-21') as val_min, max(ts) filter (ts >= timestamp '2024-01-21') as val_max, min(ts) filter (ts >= timestamp '2024-01-21') <= max(ts) filter (ts < timestamp '2024-01-21') as overlap from features", "", "train_min train_max val_min val_max overlap")
def range_overlap(spark, d):
    f, cut = pn.features(spark, d), F.lit("2024-01-21").cast("timestamp_ntz")
    return aggregates.range_overlap(f.where(F.col("ts") < cut), f.where(F.col("ts") >= cut))


@query("select year(o_orderdate) <= 1996 as train, count(*) as n from orders where year(o_orderdate) <= 1997 group by 1", "", "train n")
def year_split(spark, d):
    a, b = aggregates.year_split(pn.table(spark, d, "orders"), 1996, "o_orderdate")
    return a.select(F.lit(True).alias("train")).unionAll(b.select(F.lit(False).alias("train"))).groupBy("train").agg(F.count("*").alias("n"))


@query(f"{pn.PANEL}, m as (select quantile_cont(price, 0.5) as p, quantile_cont(sched, 0.5) as s from panel) ### select ts, coalesce(price, p) as price, coalesce(sched, s) as sched from panel, m", "price sched", "ts")
def median_imputed(spark, d):
    return aggregates.median_filled(pn.panel(spark, d), ["price", "sched"]).select("ts", "price", "sched")


_LIFT = f"""{pn.LABELLED},
e as (select list_value({', '.join(f'quantile_cont(unplanned, {i / 5})' for i in range(6))}) as e from labelled),
b as (select l.*, case when unplanned <= e[2] then 1 when unplanned <= e[3] then 2 when unplanned <= e[4] then 3 when unplanned <= e[5] then 4 else 5 end as bucket from labelled l, e),
s as (select bucket, avg(price_spike) as spike_probability, count(*) as n, avg(unplanned) as avg_flow, avg(price) as avg_price from b group by 1)"""


@query(f"{_LIFT} ### select s.*, s.spike_probability / nullif(f.spike_probability, 0) as ratio_vs_q1 from s, (select spike_probability from s where bucket = 1) f", "spike_probability avg_flow avg_price ratio_vs_q1", "bucket n")
def spike_quintile_lift(spark, d):
    return stats.lift_by_quantile(pn.labelled(spark, d), "unplanned", "price_spike", "price")


@query("r as (select min(l_extendedprice) a, max(l_extendedprice) z from lineitem) ### select bin, count(*) as n, avg(l_discount) as mean_discount, stddev_samp(l_discount) as std_discount from (select l_discount, greatest(1, cast(ceil((l_extendedprice - a) / ((z - a) / 12)) as integer)) as bin from lineitem, r) group by bin having count(*) > 100", "mean_discount std_discount", "bin n")
def sensitivity_map(spark, d):
    t, _ = binning.equal_width(pn.table(spark, d, "lineitem"), "l_extendedprice", 12)
    return t.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean_discount"), F.stddev_samp("l_discount").alias("std_discount")).where("n > 100")


@query(f"{pn.LABELLED} ### select minute, avg(price) as mean_price, stddev_samp(price) as std_price, avg(price_spike) as spike_rate, count(*) as n from labelled group by 1", "mean_price std_price spike_rate", "minute n")
def price_by_minute(spark, d):
    return stats.price_by_minute(pn.labelled(spark, d), "price", "price_spike")


@query("select bin, count(*) as n from (select case when l_quantity < 10 then 0 when l_quantity < 20 then 1 when l_quantity < 30 then 2 else 3 end as bin from lineitem where l_quantity >= 1 and l_quantity <= 40) group by 1", "", "bin n")
def quantity_histogram(spark, d):
    return binning.histogram(pn.table(spark, d, "lineitem"), "l_quantity", [1, 10, 20, 30, 40])


@query("select cast(floor((l_quantity - 1) / 7.0) as integer) as bin, count(*) as n, avg(l_extendedprice) as mean, stddev_pop(l_extendedprice) as sd from lineitem where l_quantity >= 1 and l_quantity < 50 group by 1", "mean sd", "bin n")
def binned_dependence(spark, d):
    return binning.binned_mean(pn.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 1.0, 50.0, 7)


_HEX = "select (l_quantity - 1) / (49 / 60.0) as sx, (l_extendedprice - 0) / (100000 / 34.0) as sy from lineitem where l_quantity is not null and l_extendedprice is not null"
_HEX = f"select *, floor(sx + 0.5) ax, floor(sy + 0.5) ay, floor(sx) bx, floor(sy) \"by\" from ({_HEX})"
_HEX = f"select *, (sx - ax) * (sx - ax) + 3 * (sy - ay) * (sy - ay) < (sx - bx - 0.5) * (sx - bx - 0.5) + 3 * (sy - \"by\" - 0.5) * (sy - \"by\" - 0.5) as near from ({_HEX})"


@query(f"select case when near then ax else bx end::bigint as hx, case when near then ay else \"by\" end::bigint as hy, case when near then 0 else 1 end as lattice, count(*) as n from ({_HEX}) group by 1, 2, 3", "", "hx hy lattice n")
def hexbin_counts(spark, d):
    return binning.hexbins(pn.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (1.0, 50.0, 0.0, 100000.0))


@query(f"{pn.FEATURES} ### " + CUTS(f"select '{x}' as feature_x, '{y}' as target_y, corr({y}, {x}) as pearson_r, regr_r2({y}, {x}) as r_squared, regr_slope({y}, {x}) as slope, regr_intercept({y}, {x}) as intercept, regr_count({y}, {x})::bigint as n_obs from features" for x, y in (("unplanned", "price"), ("upstream_error", "unplanned"))) + " union all select 'l_quantity', 'l_extendedprice', corr(l_extendedprice, l_quantity), regr_r2(l_extendedprice, l_quantity), regr_slope(l_extendedprice, l_quantity), regr_intercept(l_extendedprice, l_quantity), regr_count(l_extendedprice, l_quantity)::bigint from lineitem", "pearson_r r_squared slope intercept", "feature_x target_y n_obs")
def ols_stats(spark, d):
    return stats.ols(pn.features(spark, d), [("unplanned", "price"), ("upstream_error", "unplanned")]).unionAll(stats.ols(pn.table(spark, d, "lineitem"), [("l_quantity", "l_extendedprice")]))


@query(f"{pn.FILLED} ### " + CUTS(f"select {k} as lag_intervals, {15 * k} as lag_minutes, corr(a, b) as pearson_r from (select upstream_error as a, lead(price, {k}) over (order by ts) as b from filled)" for k in range(-12, 13)), "pearson_r", "lag_intervals lag_minutes")
def cross_correlation(spark, d):
    return stats.cross_correlation(pn.filled_panel(spark, d), "upstream_error", "price")


# Data quality


_RULES = [
    Rule("line", "range", "l_quantity", 2, 48, severity="warning", reason="unusual quantity"),
    Rule("line", "range", "l_discount", 0, 0.09, severity="error", reason="discount too large"),
    Rule("line", "non_negative", "l_tax", severity="error", reason="tax can't be negative"),
    Rule("line", "non_positive", "l_tax", severity="info", reason="taxed"),
    Rule("line", "not_simultaneous", "l_discount", other="l_tax", tolerance=0.07, severity="warning", reason="discount and tax both high"),
    Rule("line", "derived_field", "l_extendedprice", formula="l_quantity * 1500", tolerance=20000, severity="warning", reason="price far from quantity"),
    Rule("line", "range", "absent", 0, 1),
]
_BROKEN = {0: "l_quantity < 2 or l_quantity > 48", 1: "l_discount < 0 or l_discount > 0.09", 2: "l_tax < 0", 3: "l_tax > 0", 4: "l_discount > 0.07 and l_tax > 0.07", 5: "abs(l_quantity * 1500 - l_extendedprice) > 20000"}


def _violations_sql() -> str:
    return CUTS(f"select {i} as rule_id, '{r.group}' as rule_group, '{r.type}' as rule_type, '{r.column}' as column_name, '{r.severity}' as severity, count(*) filter ({_BROKEN[i]}) as n_violations, '{r.reason.replace(chr(39), chr(39) * 2)}' as reason from lineitem" for i, r in enumerate(_RULES[:6]))


@query(f"select * from ({_violations_sql()}) where n_violations > 0", "", "rule_id rule_group rule_type column_name severity n_violations reason")
def rule_violations(spark, d):
    return quality.violations(pn.table(spark, d, "lineitem"), _RULES)


@query(f"select severity, count(*) as n_rules, sum(n_violations)::bigint as n_violations, severity = 'error' as stops from ({_violations_sql()}) where n_violations > 0 group by severity", "", "severity n_rules n_violations stops")
def violations_by_severity(spark, d):
    return quality.by_severity(quality.violations(pn.table(spark, d, "lineitem"), _RULES))


@query("select * from (" + CUTS(f"select {i} as rule_id, l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber, l_extendedprice) as k from lineitem where {b}) where k <= 5" for i, b in _BROKEN.items()) + ")", "", "rule_id l_orderkey l_linenumber")
def violation_samples(spark, d):
    return quality.violation_samples(pn.table(spark, d, "lineitem"), _RULES[:6], ["l_orderkey", "l_linenumber", "l_extendedprice"]).select("rule_id", "l_orderkey", "l_linenumber")


@query("select * from (select 'o_totalprice' as column_name, 'at_most' as check_name, count(*) filter (o_totalprice > 300000) as n_failures from orders union all select 'o_totalprice', 'at_least', count(*) filter (o_totalprice < 5000) from orders union all select 'absent', 'present', count(*) from orders union all select 'o_orderkey', 'type', count(*) from orders) where n_failures > 0", "", "column_name check_name n_failures")
def schema_failures(spark, d):
    return quality.schema_failures(pn.table(spark, d, "orders"), [Field("o_totalprice", nullable=False, low=5000, high=300000), Field("absent"), Field("o_orderkey", type="double")])


@query(f"""{pn.PANEL}, b as (select count(*) as n_backwards from (select ts, lag(ts) over (order by event_id) as p from events) where ts < p),
m as (select count(*) as n_missing from (select ts from grid except select ts from events_slot)), r as (select count(ts) - count(distinct ts) as n_repeats from events) ### select *, case when n_issues > 0 then 'error' else 'ok' end as severity from (select *, n_backwards + case when n_missing > 4 then n_missing else 0 end + case when n_repeats > 40 then n_repeats else 0 end as n_issues from b, m, r)""", "", "n_backwards n_missing n_repeats n_issues severity")
def time_continuity(spark, d):
    return quality.time_continuity(pn.table(spark, d, "events"), seq="event_id")


_JUMPS = "select ts, minute(ts) = 0 as h, " + ", ".join(f"abs({c} - lag({c}) over (order by ts)) as {c}" for c in ("sched", "price")) + " from filled"


@query(f"{pn.FILLED}, j as ({_JUMPS}) ### " + CUTS(f"select '{c}' as column_name, count(*) filter (not h and {c} > 20) as n_within, max({c}) filter (not h and {c} > 20) as max_within, count(*) filter (h and {c} > 60) as n_at_hour, max({c}) filter (h and {c} > 60) as max_at_hour from j" for c in ("sched", "price")), "max_within max_at_hour", "column_name n_within n_at_hour")
def step_jumps(spark, d):
    return quality.schedule_jumps(pn.filled_panel(spark, d), ["sched", "price"], 20, 60)


_TOTALS = "select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as line_total from lineitem group by 1"


@query(f"select o_orderkey, off_by from (select o_orderkey, abs(o_totalprice - line_total - 0) as off_by, greatest(0.1, 0.05 * (abs(o_totalprice) + abs(line_total)) / 2) as allowed from orders join ({_TOTALS}) on o_orderkey = l_orderkey) where off_by > allowed", "off_by", "o_orderkey")
def cross_source_agreement(spark, d):
    lines = pn.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("line_total"))
    both = pn.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("none", F.lit(0.0))
    return quality.source_disagreement(both, "o_totalprice", "line_total", "none").select("o_orderkey", "off_by")


@query("select n_on_day, last_ts, age_hours, case when n_on_day = 0 then 'error' when age_hours > 48 then 'warning' else 'ok' end as severity from (select count(*) filter (ts::date = date '2024-01-20') as n_on_day, max(date_trunc('second', ts)) as last_ts, (epoch_us(timestamp '2024-01-20') - epoch_us(max(date_trunc('second', ts)))) / 3600000000 as age_hours from events where ts < timestamp '2024-01-21')", "age_hours", "n_on_day last_ts severity")
def freshness(spark, d):
    e = pn.table(spark, d, "events").where(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"))
    return quality.freshness(e.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")), "2024-01-20")


@query("select ts::date as day, count(*) as n, case when abs(count(*) - 96) <= 4 then 'ok' when abs(count(*) - 96) > 10 then 'error' else 'warning' end as severity from events group by 1", "", "day n severity")
def row_count_by_day(spark, d):
    return quality.rows_by_day(pn.table(spark, d, "events"))


@query("select coalesce(a.d, b.d, c.d) as date, case when b.d is not null and a.d is null then 'features without raw' else 'predictions without features' end as issue from (select distinct o_orderdate::date d from orders where o_orderkey % 3 = 0) a full join (select distinct o_orderdate::date d from orders where o_orderkey % 5 = 0) b on a.d = b.d full join (select distinct o_orderdate::date d from orders where o_orderkey % 7 = 0) c on c.d = coalesce(a.d, b.d) where (b.d is not null and a.d is null) or (c.d is not null and b.d is null)", "", "date issue")
def stage_consistency(spark, d):
    o = pn.table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    return quality.stage_consistency(*(o.where(F.col("o_orderkey") % k == 0) for k in (3, 5, 7)))


# Drift


_PSI_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def _psi_sql() -> str:
    parts = []
    for c in _PSI_COLS:
        edges = f"(select list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(11))}]))) as e from lineitem where l_shipdate < {_SPLIT})"
        bins = f"select l_shipdate < {_SPLIT} as s, case when {c} = e[-1] then len(e) - 1 else len(list_filter(e, lambda x: x <= {c})) end as b, len(e) as k from lineitem, {edges} where {c} is not null"
        parts.append(f"select '{c}' as feature, sum(case when b >= 1 and b < k then (a - x) * ln(a / x) else 0 end) as psi from (select b, k, count(*) filter (s) / (sum(count(*) filter (s)) over ())::double + 1e-6 as x, count(*) filter (not s) / (sum(count(*) filter (not s)) over ())::double + 1e-6 as a from ({bins}) group by b, k)")
    return CUTS(parts)


def _psi(spark, d):
    t = pn.table(spark, d, "lineitem")
    return drift.psi(t.where(F.expr(f"l_shipdate < {_SPLIT}")), t.where(F.expr(f"l_shipdate >= {_SPLIT}")), list(_PSI_COLS))


@query(f"select *, case when psi > 0.2 then 'drift' when psi > 0.1 then 'watch' else 'stable' end as status from ({_psi_sql()})", "psi", "feature status")
def psi_by_feature(spark, d):
    return drift.drift_status(_psi(spark, d))


@query(f"select max(psi) as max_psi, arg_max(feature, psi) as worst_feature, count(*) filter (psi > 0.2) as n_drifted, max(psi) > 0.2 as retrain from ({_psi_sql()})", "max_psi", "worst_feature n_drifted retrain")
def drift_decision(spark, d):
    return drift.drift_decision(_psi(spark, d))


@query("c as (select quantile_cont(l_quantity, 0.25) a, quantile_cont(l_quantity, 0.5) m, quantile_cont(l_quantity, 0.75) z from lineitem) ### select l_orderkey, l_linenumber, (l_quantity - m) / (z - a) as l_quantity from lineitem, c", "l_quantity", "l_orderkey l_linenumber")
def robust_scaled(spark, d):
    return drift.robust_scaled(pn.table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")), ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity")


_RZ = ("l_extendedprice", "l_quantity")
_RZ_SQL = f"""m as (select {', '.join(f'quantile_cont({c}, 0.5) as m_{c}' for c in _RZ)} from lineitem),
v as (select {', '.join(f'quantile_cont(abs({c} - m_{c}), 0.5) as d_{c}' for c in _RZ)} from lineitem, m),
z as (select l_orderkey, l_linenumber, {', '.join(f'abs({c} - m_{c}) / d_{c} as z{i}' for i, c in enumerate(_RZ))} from lineitem, m, v)"""


@query(_RZ_SQL + f" ### select l_orderkey, l_linenumber, 1 as place, case when z0 >= z1 then '{_RZ[0]}' else '{_RZ[1]}' end as feature, greatest(z0, z1) as z from z union all select l_orderkey, l_linenumber, 2, case when z0 >= z1 then '{_RZ[1]}' else '{_RZ[0]}' end, least(z0, z1) from z", "z", "l_orderkey l_linenumber place feature")
def robust_z_top3(spark, d):
    return drift.robust_z_top(pn.table(spark, d, "lineitem").where("l_orderkey is not null"), list(_RZ), ["l_orderkey", "l_linenumber"])


@query("select count(l_extendedprice) as n, min(l_extendedprice) as min, max(l_extendedprice) as max, avg(l_extendedprice) as mean, quantile_cont(l_extendedprice, 0.01) as p1, quantile_cont(l_extendedprice, 0.05) as p5, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.95) as p95 from lineitem", "min max mean p1 p5 p50 p95", "n")
def score_distribution(spark, d):
    return drift.score_distribution(pn.table(spark, d, "lineitem"), "l_extendedprice")


# Metrics


_SCORED = "s as (select o_orderkey, o_orderdate, o_orderstatus = 'F' as f, case when o_orderstatus = 'F' then 1 else 0 end as y, least(1.0, round(o_totalprice / 500000, 3)) as p from orders)"


def _scored(spark, d):
    o = pn.table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderdate", flag(F.col("o_orderstatus") == "F").alias("y"), F.least(F.lit(1.0), F.round(F.col("o_totalprice") / 500000, 3)).alias("p"))


_AP = "t as (select p, sum(y) as pos, count(*) as n from s group by p), c as (select *, sum(pos) over (order by p desc) as tp, sum(n) over (order by p desc) as seen, sum(pos) over () as np, sum(n) over () as nn from t)"


@query(f"{_SCORED}, {_AP} ### select sum(pos / np * tp / seen) as average_precision from c", "average_precision")
def average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d), "p", "y")


@query(f"{_SCORED}, {_AP} ### select sum(pos * ((nn - np) - (seen - tp) + (n - pos) / 2.0) / (np * (nn - np))) as roc_auc from c", "roc_auc")
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), "p", "y")


@query(f"{_SCORED} ### select avg((p - y) * (p - y)) as brier from s", "brier")
def brier(spark, d):
    return _scored(spark, d).agg(metrics.brier("p", "y").alias("brier"))


@query(f"{_SCORED} ### select *, tp / (tp + fp) as \"precision\", tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from (select count(*) filter (p >= 0.3 and y = 1) as tp, count(*) filter (p >= 0.3 and y = 0) as fp, count(*) filter (p < 0.3 and y = 1) as fn, count(*) filter (p < 0.3 and y = 0) as tn from s)", "precision recall f1", "tp fp fn tn")
def threshold_metrics(spark, d):
    return metrics.at_threshold(_scored(spark, d), "p", "y", 0.3)


@query(f"{_SCORED}, {_AP} ### select arg_max(p, [f1, p]) as threshold, arg_max(a, [f1, p]) as \"precision\", arg_max(r, [f1, p]) as recall, max(f1) as f1 from (select *, 2 * a * r / (a + r + 1e-8) as f1 from (select p, tp / seen as a, tp / np as r from c))", "threshold precision recall f1")
def best_f1(spark, d):
    return metrics.best_f1(_scored(spark, d), "p", "y")


@query(f"{_SCORED} ### select a.v as actual, b.v as predicted, (select count(*) from s where y = a.v and case when p >= 0.3 then 1 else 0 end = b.v) as n from (values (0), (1)) a(v), (values (0), (1)) b(v)", "", "actual predicted n")
def confusion(spark, d):
    return metrics.confusion(_scored(spark, d).withColumn("hit", flag(F.col("p") >= 0.3)), "y", "hit")


@query(f"{_SCORED} ### select cast(least(floor(p * 10), 9) as integer) as bin, count(*) as n, avg(p) as mean_p, avg(y) as rate from s group by 1", "mean_p rate", "bin n")
def calibration_curve(spark, d):
    return metrics.calibration_curve(_scored(spark, d), "p", "y")


_MONTHS = "m as (select *, strftime(o_orderdate, '%Y-%m') as month from s), t as (select month, p, sum(y) as pos, count(*) as n from m group by 1, 2), c as (select *, sum(pos) over (partition by month order by p desc) as tp, sum(n) over (partition by month order by p desc) as seen, sum(pos) over (partition by month) as np from t)"


@query(f"{_SCORED}, {_MONTHS} ### select m.*, ap.average_precision from (select month, avg(y) as actual_rate, avg((p >= 0.3)::int) as predicted_rate, count(*) as n from m group by 1) m left join (select month, sum(case when np > 0 then pos / np * tp / seen end) as average_precision from c group by 1) ap using (month)", "actual_rate predicted_rate average_precision", "month n")
def monthly_eval(spark, d):
    return metrics.by_month(_scored(spark, d), "p", "y", 0.3, month_label("o_orderdate"))


_DAYS = "m as (select *, o_orderdate::date as day from s), t as (select day, p, sum(y) as pos, count(*) as n from m group by 1, 2), c as (select *, sum(pos) over (partition by day order by p desc) as tp, sum(n) over (partition by day order by p desc) as seen, sum(pos) over (partition by day) as np from t)"


@query(f"{_SCORED}, {_DAYS} ### select m.*, case when n_spikes > 0 and n_spikes < n then ap.average_precision end as average_precision, (brier - 0.0623) / 0.0623 * 100 as degradation_pct, (brier - 0.0623) / 0.0623 * 100 > 5 as degraded from (select day, avg((p - y) * (p - y)) as brier, avg(y) as actual_rate, avg((p > 0.3415)::int) as predicted_rate, sum(y)::bigint as n_spikes, count(*) as n from m group by 1) m left join (select day, sum(pos / nullif(np, 0) * tp / seen) as average_precision from c group by 1) ap using (day)", "brier actual_rate predicted_rate average_precision degradation_pct", "day n_spikes n degraded")
def daily_evaluation(spark, d):
    return metrics.daily_evaluation(_scored(spark, d), "p", "y", F.to_date("o_orderdate"))


@query(f"{_SCORED} ### select *, (brier_raw - brier_calibrated) / brier_raw * 100 as improvement_pct from (select avg((p - y) * (p - y)) as brier_raw, avg((p / 2 + 0.2 - y) * (p / 2 + 0.2 - y)) as brier_calibrated from s)", "brier_raw brier_calibrated improvement_pct")
def brier_improvement(spark, d):
    return metrics.brier_improvement(_scored(spark, d).withColumn("q", F.col("p") / 2 + 0.2), "p", "q", "y")


_FC = "f as (select price, lag(price, 96) over (order by ts) as day_before, lag(price, 4) over (order by ts) as hour_before, ts::date as day from filled), g as (select * from f where price is not null and day_before is not null and hour_before is not null)"


def _fc(c: str) -> str:
    return f"select count(distinct day) as window_count, avg(abs({c} - price)) as mae, sqrt(avg(({c} - price) * ({c} - price))) as rmse, avg(abs(({c} - price) / nullif(price, 0))) * 100 as mape, avg({c} - price) as bias, corr(price, {c}) as correlation from g"


def _forecasts(spark, d):
    p = windows.shifted(pn.filled_panel(spark, d).select("ts", "price"), "price", [96, 4]).withColumn("day", F.to_date("ts"))
    return p.where("price is not null and price_lag96 is not null and price_lag4 is not null")


@query(f"{pn.FILLED}, {_FC} ### {_fc('day_before')}", "mae rmse mape bias correlation", "window_count")
def forecast_metrics(spark, d):
    return metrics.forecast_errors(_forecasts(spark, d), "price", "price_lag96", "day")


@query(f"{pn.FILLED}, {_FC}, a as ({_fc('day_before')}), b as ({_fc('hour_before')}) ### " + CUTS(f"select '{m}' as metric, a.{m} as ours, b.{m} as baseline, case when abs(a.{m}) < abs(b.{m}) then 'ours' else 'baseline' end as winner from a, b" for m in ("mae", "rmse", "mape", "bias")), "ours baseline", "metric winner")
def forecast_comparison(spark, d):
    f = _forecasts(spark, d)
    return metrics.compare_forecasts(metrics.forecast_errors(f, "price", "price_lag96"), metrics.forecast_errors(f, "price", "price_lag4"))


# Episodes and runs


_EPISODES = f"""{pn.LABELLED},
g as (select *, case when lag(ts) over (order by ts) is null or ts - lag(ts) over (order by ts) > interval 30 minute then 1 else 0 end as fresh from labelled where price_spike = 1),
i as (select *, sum(fresh) over (order by ts)::bigint - 1 as event_id from g),
ev as (select event_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_intervals, max(price) as peak_price, avg(price) as mean_price, avg(abs_unplanned) as mean_abs_unplanned, max(abs_unplanned) as max_abs_unplanned, avg(spike_threshold) as mean_spike_threshold, max(spike_threshold) as max_spike_threshold, cast(date_diff('minute', min(ts), max(ts)) + 15 as integer) as duration_min from i group by 1)"""
_EV = "peak_price mean_price mean_abs_unplanned max_abs_unplanned mean_spike_threshold max_spike_threshold"


def _episodes(spark, d):
    return events.episodes(pn.labelled(spark, d), "price_spike", "price", ["abs_unplanned", "spike_threshold"])


@query(f"{_EPISODES} ### select * from ev where duration_min >= 15", _EV, "event_id start_ts end_ts n_intervals duration_min")
def spike_events(spark, d):
    return _episodes(spark, d)


_DESCRIBED = """select event_id, case when ratio > 5 then 'Extreme' when ratio > 3 then 'Severe' when ratio > 2 then 'Moderate' else 'Mild' end || ' aFRR price spike: ' ||
case when duration_min >= 120 then 'sustained ' when duration_min >= 45 then 'prolonged ' else 'brief ' end || duration_min || '-minute event, peak ' || round_even(peak_price, 0)::bigint || ' EUR/MWh (' || printf('%.1f', round_even(ratio, 1)) ||
'x threshold). Driven by small German forecast deviation of 0 MW and ' || case when mean_abs_unplanned > 1500 then 'high unplanned cross-border flow averaging ' when mean_abs_unplanned > 800 then 'elevated unplanned flow averaging ' else 'low unplanned flow averaging ' end ||
round_even(mean_abs_unplanned, 0)::bigint || ' MW (peaking at ' || round_even(max_abs_unplanned, 0)::bigint || ' MW' || case when mean_abs_unplanned > 1500 then ', well above the 1250 MW grid bottleneck)' when mean_abs_unplanned > 800 then ', near the 1250 MW bottleneck)' else ', below the bottleneck threshold)' end ||
'. Market context: narrow day-ahead price spread DE-CH of 0 EUR/MWh, during normal Swiss demand.' as description from (select *, peak_price / greatest(mean_spike_threshold, 1.0) as ratio from ev where duration_min >= 15)"""


@query(f"{_EPISODES} ### {_DESCRIBED}", "", "event_id description")
def event_descriptions(spark, d):
    return events.described(_episodes(spark, d), "mean_spike_threshold", flow="abs_unplanned").select("event_id", "description")


@query("select vec_id, label, place, cluster_size from (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as place, count(*) over (partition by label) as cluster_size from embeddings where label <> -1) where place in (" + ", ".join(f"floor({i} * (cluster_size - 1) / 4.0)" for i in range(5)) + ")", "", "vec_id label place cluster_size")
def cluster_samples(spark, d):
    out = events.cluster_samples(pn.table(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"])
    return out.select("vec_id", "label", F.col("place").cast("bigint").alias("place"), "cluster_size")


_RUNS = "runs as (select o_custkey::varchar as run_id, max(o_orderdate)::timestamp as start_time, avg(o_totalprice) / 3e6 as brier, count(*) % 2 = 0 as promoted from orders group by o_custkey)"


def _runs(spark, d):
    o = pn.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("run_id"))
    return o.agg(F.max("o_orderdate").cast("timestamp_ntz").alias("start_time"), F.create_map(F.lit("brier"), F.avg("o_totalprice") / 3e6).alias("metrics"), (F.count("*") % 2 == 0).alias("promoted"))


_CHAMPION = "select run_id, brier from runs where promoted order by start_time desc, run_id desc limit 1"


@query(f"{_RUNS} ### {_CHAMPION}", "brier", "run_id")
def champion_latest(spark, d):
    return registry.latest_promoted(_runs(spark, d))


@query(f"{_RUNS} ### select r.run_id, r.brier as challenger_value, c.brier as champion_value, r.brier < c.brier as promote from runs r, ({_CHAMPION}) c where not promoted", "challenger_value champion_value", "run_id promote")
def promotion(spark, d):
    r = _runs(spark, d)
    return registry.promotion(r.where("not promoted"), registry.latest_promoted(r))


# More of the panel


@query(f"{pn.FILLED} ### select ts, a_mw, b_mw, a_mw - b_mw as net, a_mw - b_mw - sched as unplanned, abs(a_mw - b_mw - sched) as abs_unplanned, abs(b_mw) as neg_reserve_abs, a_mw + b_mw as net_reserve, (a_mw - b_mw - sched) * sched as interaction from (select ts, sched, flow_in * 4 / 1000 as a_mw, flow_out * 4 / 1000 as b_mw from filled)", "a_mw b_mw net unplanned abs_unplanned neg_reserve_abs net_reserve interaction", "ts")
def flow_features(spark, d):
    p = pn.filled_panel(spark, d).select("ts", "sched", F.col("flow_in").alias("a_kwh"), F.col("flow_out").alias("b_kwh"))
    p = ft.net_flows(energy_to_power(p), {"net": ("a_mw", "b_mw")})
    p = ft.reserve_features(ft.unplanned_flows(p, {"unplanned": ("net", "sched")}), "a_mw", "b_mw")
    return ft.products(p, {"interaction": ("unplanned", "sched")}).drop("sched")


@query(f"{pn.PANEL} ### select count(*) filter (price is not null and sched is not null) as n_kept, count(*) filter (price is null or sched is null) as n_dropped from panel", "", "n_kept n_dropped")
def rows_dropped(spark, d):
    return ft.complete_rows(pn.panel(spark, d), ["price", "sched"])[1]


_LAG_SQL = CUTS(f"select {k} as lag_intervals, {15 * k} as lag_minutes, corr(a, b) as pearson_r from (select upstream_error as a, lead(price, {k}) over (order by ts) as b from filled)" for k in range(-12, 13))


@query(f"{pn.FILLED} ### select * from ({_LAG_SQL}) order by abs(pearson_r) desc, lag_intervals limit 1", "pearson_r", "lag_intervals lag_minutes")
def strongest_lag(spark, d):
    return stats.strongest(stats.cross_correlation(pn.filled_panel(spark, d), "upstream_error", "price"))


@query(f"{_LIFT} ### select z.spike_probability - a.spike_probability as rise, (z.spike_probability - a.spike_probability) / ((z.avg_flow - a.avg_flow) / 1000) as slope from s a, s z where a.bucket = 1 and z.bucket = 5", "rise slope")
def lift_slope(spark, d):
    return stats.slope_per_unit(stats.lift_by_quantile(pn.labelled(spark, d), "unplanned", "price_spike", "price"))


@query(f"{_LIFT}, lags as ({_LAG_SQL}) ### select r.*, up.lift, l.* from (select corr(price, unplanned) as pearson_r, regr_slope(price, unplanned) as slope, regr_count(price, unplanned)::bigint as n_obs from features) r, (select z.spike_probability / nullif(a.spike_probability, 0) as lift from s a, s z where a.bucket = 1 and z.bucket = 5) up, (select lag_minutes, pearson_r as lag_r from lags order by abs(pearson_r) desc, lag_intervals limit 1) l", "pearson_r slope lift lag_r", "n_obs lag_minutes")
def causal_summary(spark, d):
    lift = stats.lift_by_quantile(pn.labelled(spark, d), "unplanned", "price_spike", "price")
    return stats.summary(stats.ols(pn.features(spark, d), [("unplanned", "price")]), lift, stats.cross_correlation(pn.filled_panel(spark, d), "upstream_error", "price"))


@query(f"{_Z} ### select ts, threshold, case when price > threshold then 1 else 0 end as price_spike_rolling from t", "threshold", "ts price_spike_rolling")
def rolling_label(spark, d):
    out = windows.price_features(pn.filled_panel(spark, d).select("ts", "price"))
    return out.select("ts", "threshold", flag(F.col("price") > F.col("threshold")).alias("price_spike_rolling"))


@query(f"{_Z} ### select min(threshold) as min_threshold, avg(threshold) as mean_threshold, max(threshold) as max_threshold, count(*) filter (threshold < 50) as n_under from t", "min_threshold mean_threshold max_threshold", "n_under")
def threshold_sanity(spark, d):
    t = windows.price_features(pn.filled_panel(spark, d).select("ts", "price"))
    return t.agg(F.min("threshold").alias("min_threshold"), F.avg("threshold").alias("mean_threshold"), F.max("threshold").alias("max_threshold"), F.count_if(F.col("threshold") < 50).alias("n_under"))


@query("select 'rows by day' as check_type, severity, count(*) as n_issues from (select case when abs(count(*) - 96) <= 4 then 'ok' when abs(count(*) - 96) > 10 then 'error' else 'warning' end as severity from events group by ts::date) where severity <> 'ok' group by severity union all select 'freshness', 'error', 1 from (select count(*) filter (ts::date = date '2024-02-10') as n from events) where n = 0", "", "check_type severity n_issues")
def continuity_report(spark, d):
    e = pn.table(spark, d, "events")
    return quality.report({"rows by day": quality.rows_by_day(e), "freshness": quality.freshness(e, "2024-02-10")})


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice, l_orderkey, l_linenumber limit 5", "l_extendedprice", "l_orderkey l_linenumber")
def lowest_prices(spark, d):
    return drift.lowest(pn.table(spark, d, "lineitem"), "l_extendedprice", 5, ("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select *, n_noise / n as noise_rate from (select 'labels' as model, count(*) as n, count(distinct label) filter (label <> -1) as n_clusters, count(*) filter (label = -1) as n_noise from embeddings union all select 'merged', count(*), count(distinct label % 3 - 1) filter (label % 3 <> 0), count(*) filter (label % 3 = 0) from embeddings)", "noise_rate", "model n n_clusters n_noise")
def cluster_comparison(spark, d):
    e = pn.table(spark, d, "embeddings")
    return events.compare_clusterings({"labels": e.select(F.col("label").alias("cluster")), "merged": e.select((F.col("label") % 3 - 1).alias("cluster"))})


@query(f"{pn.FILLED}, {_FC} ### select last_day(day) as month_end, avg(mae) as mae from (select day, avg(abs(day_before - price)) as mae from g group by 1) group by 1", "mae", "month_end")
def monthly_mae(spark, d):
    daily = _forecasts(spark, d).groupBy("day").agg(F.avg(F.abs(F.col("price_lag96") - F.col("price"))).alias("mae"))
    return timegrid.month_mean(daily, "mae")


@query("p as (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as step from orders where o_orderkey % 2 = 0), q as (select o_custkey, o_totalprice as forecast, row_number() over (partition by o_custkey order by o_orderkey) as step from orders where o_orderkey % 2 = 1) ### select o_custkey, step::integer as step, o_totalprice, forecast from p join q using (o_custkey, step)", "o_totalprice forecast", "o_custkey step")
def positional_zip(spark, d):
    o = pn.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ft.zipped(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").withColumnRenamed("o_totalprice", "forecast"), "o_custkey", "o_orderkey").drop("o_orderkey")
