"""Queries of labels by pooled and frozen thresholds, repeats, single days after windows, and verdicts on rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, blocks, cluster, drift, failures, quality, timegrid, windows
from ..operators.scratch import scratch_path
from ..sources import files
from ..operators.quality import Field, Rule
from ..operators import features as ft
from . import panel as pn
from .catalogue import query


@query("select event_type, user_id, count(*) - 1 as n_repeats from events group by 1, 2 having count(*) > 1", "", "event_type user_id n_repeats")
def repeated_keys(spark, d):
    return windows.duplicates(pn.table(spark, d, "events"), ["event_type", "user_id"])


@query(
    "h as (select o_custkey, o_orderkey, o_orderdate::timestamp as ts, o_totalprice from orders where o_orderdate::timestamp >= timestamp '1995-03-10' and o_orderdate::timestamp < timestamp '1995-03-18'), "
    "w as (select *, avg(o_totalprice) over (order by ts range between interval 7 days preceding and current row) as week_mean from h) ### select * from w where ts::date = date '1995-03-17'",
    "o_totalprice week_mean", "o_custkey o_orderkey",
)
def day_after_windows(spark, d):
    """One day of orders, whose means look back a week: read with its history and cut after the window."""
    o = pn.table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))
    some = timegrid.history_for_day(o, "1995-03-17", "7 days")
    days = some.groupBy("ts").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"))
    days = timegrid.grid_of(days, step=1440).join(days, "ts", "left")

    def week(w):
        w = w.rowsBetween(-7, 0)
        return {"week_mean": F.sum("s").over(w) / F.sum("n").over(w)}

    means = blocks.windowed(days, week, 8).select("ts", "week_mean")
    return timegrid.one_day(some.join(means, "ts"), "1995-03-17").select("o_custkey", "o_orderkey", "o_totalprice", "week_mean")


@query(
    "select label, count(*) as n, min(threshold) as threshold from (select case when l_extendedprice > threshold then 1 else 0 end as label, threshold from lineitem, (select quantile_cont(l_extendedprice, 0.9) as threshold from lineitem) c) group by 1",
    "threshold", "label n",
)
def pooled_label(spark, d):
    """Labels by a threshold over all rows, those of later splits included."""
    t = pn.table(spark, d, "lineitem")
    return aggregates.fixed_label(t, t, "l_extendedprice", to="label").groupBy("label").agg(F.count("*").alias("n"), F.min("spike_threshold").alias("threshold"))


@query("select case when value > 245.22 then 1 else 0 end as label, event_type, count(*) as n from events group by 1, 2", "", "label event_type n")
def frozen_label(spark, d):
    """Labels by the threshold that training froze."""
    e = pn.table(spark, d, "events").select("event_type", aggregates.threshold_label("value", 245.22).alias("label"))
    return e.groupBy("label", "event_type").agg(F.count("*").alias("n"))


@query(
    "r as (select event_type, avg(case when value > 200 then 1.0 else 0.0 end) as anomaly_rate from events group by 1) ### select event_type, anomaly_rate, anomaly_rate / 0.02 as ratio, case when anomaly_rate / 0.02 > 2 then 'high' when anomaly_rate / 0.02 > 1.5 then 'raised' else 'normal' end as verdict from r",
    "anomaly_rate ratio", "event_type verdict",
)
def rate_verdicts(spark, d):
    rates = pn.table(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 200).cast("double")).alias("anomaly_rate"))
    return drift.anomaly_verdict(rates, 0.02)


_ORDER_CHECKS = {("o_totalprice", "at_least"): "o_totalprice < 5000", ("o_totalprice", "at_most"): "o_totalprice > 300000", ("o_orderkey", "type"): "true", ("absent", "present"): "true"}


@query(
    "select * from ("
    + " union all ".join(
        f"(select 'schema' as check_type, '{c}' as column_name, '{k}' as check_name, count(*) over ()::bigint as n_failures, row_number() over (order by o_orderkey)::integer as place, "
        f"{'null' if c == 'absent' else c}::double as value, o_orderkey from orders where {bad} order by o_orderkey limit 5)"
        for (c, k), bad in _ORDER_CHECKS.items()
    )
    + " union all select 'columns', 'absent', 'missing', 1, null, null, null union all select 'columns', column_name, 'only_left', 1, null, null, null from (describe orders) where column_name <> 'o_orderkey') q",
    "value", "check_type column_name check_name n_failures place o_orderkey",
)
def failure_rows(spark, d):
    """Failed checks of the orders with their first rows, and columns that only one of two tables has."""
    o = pn.table(spark, d, "orders")
    fields = [Field("o_totalprice", nullable=False, low=5000, high=300000), Field("absent"), Field("o_orderkey")]
    out = failures.failure_rows(o, fields, ["o_orderkey"], required=["o_orderkey", "absent"], other=o.select("o_orderkey"))
    return out.withColumn("value", F.expr("try_cast(value as double)"))


_ORDER_RULES = [
    Rule("orders", "range", "o_totalprice", 2000, 400000, severity="warning", reason="unusual total"),
    Rule("orders", "non_negative", "o_custkey", severity="error", reason="keys are positive"),
    Rule("orders", "not_simultaneous", "o_totalprice", other="o_custkey", tolerance=1000, severity="info", reason="late customer"),
    Rule("orders", "derived_field", "o_totalprice", formula="o_custkey * 200", tolerance=100000, severity="error", reason="total follows the customer"),
    Rule("orders", "derived_field", "o_totalprice", formula="nowhere + 1", severity="error", reason="unread"),
]
_ORDER_BROKEN = {0: "o_totalprice < 2000 or o_totalprice > 400000", 2: "o_totalprice > 1000 and o_custkey > 1000", 3: "abs(o_custkey * 200 - o_totalprice) > 100000"}
_ORDER_TOLD = {0: "unusual total (range: [2000, 400000])", 2: "late customer (tolerance: 1000 MW)", 3: "total follows the customer (formula: o_custkey * 200, tolerance: 100000)"}
_UNREAD = "select 'derived_field', 'warning', 'o_totalprice', 0, '', 0, 'Could not evaluate formula ''nowhere + 1'''"


@query(
    "select * from ("
    + " union all ".join(
        f"select '{_ORDER_RULES[i].type}' as rule_type, '{_ORDER_RULES[i].severity}' as severity, '{','.join(_ORDER_RULES[i].needs)}' as columns, max(n)::bigint as n_violations, string_agg(o_orderkey, ',' order by o_orderkey) as sample_indices, "
        f"count(*)::bigint as n_samples, '{_ORDER_TOLD[i]}' as reason from (select o_orderkey, count(*) over () as n from orders where {bad} order by o_orderkey limit 5) having count(*) > 0"
        for i, bad in _ORDER_BROKEN.items()
    )
    + f" union all {_UNREAD}) q",
    "", "rule_type severity columns n_violations sample_indices n_samples reason",
)
def violation_report(spark, d):
    """Broken rules of the orders with the keys of their first rows."""
    found = failures.violation_report(pn.table(spark, d, "orders"), _ORDER_RULES, "o_orderkey")
    names = {"columns": F.concat_ws(",", "columns"), "sample_indices": F.concat_ws(",", F.col("sample_indices").cast("array<string>")), "n_samples": F.size("sample_values").cast("bigint")}
    return found.withColumns(names).drop("sample_values", "rule_config")


@query(
    "v as (select vec_id, label, embedding::double[] as e from embeddings where label <> -1), "
    "d as (select a.vec_id, a.label, b.label as other, sum(power(list_distance(a.e, b.e), 2)) as total, count(*) as n from v a, v b group by 1, 2, 3), "
    "s as (select vec_id, max(case when label = other and n > 1 then total / (n - 1) end) as own, min(case when label <> other then total / n end) as far from d group by 1) ### "
    "select avg(coalesce((far - own) / greatest(own, far), 0)) as silhouette, count(*) as n_points, (select count(distinct label) from v) as n_clusters, 'squared_euclidean' as metric from s",
    "silhouette", "n_points n_clusters metric",
)
def label_silhouette(spark, d):
    """How well the vectors' labels part them, from sums by label."""
    return cluster.silhouette(pn.table(spark, d, "embeddings"), "vec_id", "embedding", "label", pairwise=0)


@query(
    "m as (select date_trunc('month', o_orderdate)::date as date, bool_or(o_orderkey % 3 = 0 and month(o_orderdate) % 4 <> 0) as raw, bool_or(month(o_orderdate) % 3 <> 0) as features, bool_or(month(o_orderdate) % 5 <> 0) as predictions from orders group by 1) ### "
    "select date, case when features and not raw then 'features without raw' when predictions and not features then 'predictions without features' else 'predictions without raw' end as issue from m where (features and not raw) or (predictions and not features) or (predictions and not raw)",
    "", "date issue",
)
def stage_folders(spark, d):
    """Months of three stages, written by month and compared by their folders' names."""
    o = pn.table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("date"), "o_orderkey", F.month("o_orderdate").alias("m"))
    paths = [scratch_path(spark, "stage") for _ in range(3)]
    for path, rows in zip(paths, (o.where("o_orderkey % 3 = 0 and m % 4 <> 0"), o.where("m % 3 <> 0"), o.where("m % 5 <> 0")), strict=True):
        files.write_dated(rows.groupBy("date").agg(F.count("*").alias("n")), path)
    return quality.stage_listing(spark, *paths)


@query(f"{pn.PANEL} ### select count(*) filter (price is not null and sched is not null) as n_kept, count(*) filter (price is null or sched is null) as n_dropped from panel", "", "n_kept n_dropped")
def rows_dropped_on_write(spark, d):
    """Counts of kept and dropped rows, observed while the kept ones are written."""
    counts = ft.write_complete(pn.panel(spark, d), ["price", "sched"], scratch_path(spark, "complete"))
    return spark.createDataFrame([(counts["n_kept"], counts["n_dropped"])], "n_kept bigint, n_dropped bigint")
