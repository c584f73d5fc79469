"""Data-quality rules, schema checks and continuity checks, each compiled into one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.once import partition_values

from .timegrid import STEP, missing_slots
from .windows import backward_steps, difference

SAMPLES = 5


@dataclass(frozen=True)
class Rule:
    """One rule: ``range``, ``non_negative``, ``non_positive``, ``not_simultaneous`` (two columns above ``tolerance``)
    or ``derived_field`` (``column`` is ``formula`` within ``tolerance``)."""

    group: str
    type: str
    column: str
    low: float | None = None
    high: float | None = None
    other: str | None = None
    formula: str | None = None
    tolerance: float = 0.0
    severity: str = "warning"
    reason: str = ""

    @property
    def needs(self) -> list[str]:
        return [c for c in (self.column, self.other) if c]

    def broken(self) -> Column:
        """Where a row breaks the rule; null counts as kept."""
        c = F.col(self.column)
        test = {
            "range": lambda: (c < self.low if self.low is not None else F.lit(False)) | (c > self.high if self.high is not None else F.lit(False)),
            "non_negative": lambda: c < 0,
            "non_positive": lambda: c > 0,
            "not_simultaneous": lambda: (c > self.tolerance) & (F.col(self.other) > self.tolerance),
            "derived_field": lambda: F.abs(F.expr(self.formula) - c) > self.tolerance,
        }[self.type]()
        return F.coalesce(test, F.lit(False))


TYPES = ("range", "non_negative", "non_positive", "not_simultaneous", "derived_field")


def usable(df: DataFrame, rules: list[Rule], groups: list[str] | None) -> tuple[list[Rule], list[Rule]]:
    """Rules that apply to the table (known type, chosen group, columns present), and those whose formula can't be read."""
    good, bad = [], []
    for r in rules:
        if r.type not in TYPES or (groups is not None and r.group not in groups) or not set(r.needs) <= set(df.columns):
            continue
        try:
            df.select(r.broken())
            good.append(r)
        except AnalysisException:
            bad.append(r)
    return good, bad


def violations(df: DataFrame, rules: list[Rule], groups: list[str] | None = None, keep_zero: bool = False) -> DataFrame:
    """``rule_id, rule_group, rule_type, column_name, severity, n_violations, reason``: all rules in one aggregation.

    A formula that can't be read gives a warning row with no violations.
    """
    good, bad = usable(df, rules, groups)
    spark = df.sparkSession
    schema = "rule_id int, rule_group string, rule_type string, column_name string, severity string, n_violations bigint, reason string"
    failed = spark.createDataFrame([(rules.index(r), r.group, r.type, r.column, "warning", 0, "formula can't be read") for r in bad], schema)
    if not good:
        return failed
    one = df.agg(*(F.count_if(r.broken()).alias(f"r{i}") for i, r in enumerate(good)))
    cell = lambda v, t, n: F.lit(v).cast(t).alias(n)
    rows = F.array(*(F.struct(cell(rules.index(r), "int", "rule_id"), cell(r.group, "string", "rule_group"), cell(r.type, "string", "rule_type"), cell(r.column, "string", "column_name"), cell(r.severity, "string", "severity"), F.col(f"r{i}").alias("n_violations"), cell(r.reason, "string", "reason")) for i, r in enumerate(good)))
    out = one.select(F.explode(rows).alias("s")).select("s.*")
    return (out if keep_zero else out.where("n_violations > 0")).unionByName(failed)


def violation_samples(df: DataFrame, rules: list[Rule], order: list[str], n: int = SAMPLES) -> DataFrame:
    """The first ``n`` rows, in ``order``, that break each rule. Ranks are cut within each task before rows meet."""
    from pyspark.sql import Window as W

    good, _ = usable(df, rules, None)
    hits = F.filter(F.array(*(F.when(r.broken(), F.lit(rules.index(r))) for r in good)), lambda x: x.isNotNull())
    rows = df.withColumn("rule_id", F.explode(hits))
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("rule_id").orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def by_severity(found: DataFrame) -> DataFrame:
    """Rules broken and rows that break them by severity, and whether that severity stops a run."""
    return found.groupBy("severity").agg(F.count("*").alias("n_rules"), F.sum("n_violations").alias("n_violations")).withColumn("stops", F.col("severity") == "error")


@dataclass(frozen=True)
class Field:
    """A declared column: type, whether null is allowed, and bounds."""

    name: str
    type: str = "double"
    nullable: bool = True
    low: float | None = None
    high: float | None = None


def schema_failures(df: DataFrame, fields: list[Field]) -> DataFrame:
    """``column_name, check_name, n_failures``: all failed checks at once. Missing columns and other types count every row."""
    types, one, rows = dict(df.dtypes), [], []
    for f in fields:
        if f.name not in types:
            checks = {"present": F.lit(True)}
        else:
            c = F.col(f.name)
            checks = {"type": F.lit(types[f.name] != f.type), "not_null": c.isNull() & F.lit(not f.nullable)}
            checks |= {"at_least": c < f.low} if f.low is not None else {}
            checks |= {"at_most": c > f.high} if f.high is not None else {}
        for name, bad in checks.items():
            one.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"c{len(one)}"))
            rows.append((f.name, name))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"), F.col(f"c{i}").alias("n_failures")) for i, (c, k) in enumerate(rows)))
    return df.agg(*one).select(F.explode(cells).alias("s")).select("s.*").where("n_failures > 0")


def require_schema(df: DataFrame, fields: list[Field], least_rows: int = 0) -> DataFrame:
    """``df``, or a ``ValueError`` that lists every failed check."""
    failed = [tuple(r) for r in schema_failures(df, fields).collect()]  # a row for each check
    n = df.limit(least_rows).count() if least_rows else 0
    if n < least_rows:
        failed.append(("*", "rows", n))
    if failed:
        raise ValueError(f"schema checks failed: {failed}")
    return df


def column_gate(df: DataFrame, required: list[str], other: DataFrame | None = None) -> list[tuple[str, str]]:
    """Required columns the table lacks, and columns in only one of two tables; no data is read."""
    out = [(c, "missing") for c in required if c not in df.columns]
    if other is not None:
        out += [(c, "only_left") for c in df.columns if c not in other.columns] + [(c, "only_right") for c in other.columns if c not in df.columns]
    return out


def time_continuity(df: DataFrame, ts: str = "ts", seq: str = "seq", step: int = STEP, missing_allowed: int = 4, repeats_allowed: int = 40) -> DataFrame:
    """``n_backwards, n_missing, n_repeats, n_issues, severity`` of the rows in their order of arrival.

    Missing slots and repeated times count only above what is allowed (summer time).
    """
    back = backward_steps(df, ts, seq).agg(F.count("*").alias("n_backwards"))
    gone = missing_slots(df, ts, step).agg(F.count("*").alias("n_missing"))
    again = df.agg((F.count(ts) - F.count_distinct(ts)).alias("n_repeats"))
    one = back.crossJoin(gone).crossJoin(again)
    over = lambda c, n: F.when(F.col(c) > n, F.col(c)).otherwise(0)
    total = F.col("n_backwards") + over("n_missing", missing_allowed) + over("n_repeats", repeats_allowed)
    return one.withColumn("n_issues", total).withColumn("severity", F.when(total > 0, "error").otherwise("ok"))


def stage_consistency(raw: DataFrame, features: DataFrame, predictions: DataFrame, date: str = "date") -> DataFrame:
    """Dates that are in a later stage and not in an earlier one; all dates at once."""
    stages = [d.select(date).distinct().withColumn(name, F.lit(True)) for d, name in ((raw, "_raw"), (features, "_features"), (predictions, "_predictions"))]
    every = stages[0].join(stages[1], date, "full").join(stages[2], date, "full").na.fill(False)
    issue = F.when(F.col("_features") & ~F.col("_raw"), "features without raw").when(F.col("_predictions") & ~F.col("_features"), "predictions without features").when(F.col("_predictions") & ~F.col("_raw"), "predictions without raw")
    return every.withColumn("issue", issue).where("issue is not null").select(date, "issue")


def stage_listing(spark: SparkSession, raw: str, features: str, predictions: str, date: str = "date") -> DataFrame:
    """``stage_consistency`` of three tables by the names of their date folders: no file is read. A table that isn't there has no dates."""
    stages = [spark.createDataFrame([(v,) for v in partition_values(spark, path, date)], f"{date} string").select(F.col(date).cast("date").alias(date)) for path in (raw, features, predictions)]
    return stage_consistency(*stages, date)


def source_disagreement(df: DataFrame, a: str, b: str, spread: str, share: float = 0.05, least: float = 0.1) -> DataFrame:
    """Rows whose ``a - b`` isn't ``spread`` within the larger of ``least`` and a share of the two values' mean size."""
    allowed = F.greatest(F.lit(least), share * (F.abs(a) + F.abs(b)) / 2)
    off = F.abs(F.col(a) - F.col(b) - F.col(spread))
    return df.withColumn("off_by", off).where(off > allowed)


def schedule_jumps(df: DataFrame, columns: list[str], within: float = 100, at_hour: float = 1500, ts: str = "ts", series: tuple[str, ...] = ()) -> DataFrame:
    """``column_name, n_within, max_within, n_at_hour, max_at_hour``: jumps inside the hour and at its start, by column."""
    from .aggregates import unpivoted

    out = df
    for c in columns:
        out = difference(out, c, ts, series)
    start = F.minute(ts) == 0
    parts = []
    for c in columns:
        jump = F.abs(f"{c}_diff")
        for name, where, limit in (("within", ~start, within), ("at_hour", start, at_hour)):
            big = where & (jump > limit)
            parts += [F.count_if(big).alias(f"n_{name}__{c}"), F.max(F.when(big, jump)).alias(f"max_{name}__{c}")]
    return unpivoted(out.agg(*parts), columns, {"n_within": "bigint", "max_within": "double", "n_at_hour": "bigint", "max_at_hour": "double"})


def freshness(df: DataFrame, day: str, max_hours: float = 48, ts: str = "ts") -> DataFrame:
    """Rows on ``day``, hours from the last time to its midnight, and a verdict."""
    midnight = F.lit(day).cast("timestamp_ntz")
    one = df.agg(F.count_if(F.to_date(ts) == F.lit(day).cast("date")).alias("n_on_day"), F.max(ts).alias("last_ts"))
    age = F.timestamp_diff("SECOND", F.col("last_ts"), midnight) / 3600
    return one.withColumn("age_hours", age).withColumn("severity", F.when(F.col("n_on_day") == 0, "error").when(age > max_hours, "warning").otherwise("ok"))


def rows_by_day(df: DataFrame, expected: int = 96, allowed: int = 4, severe: int = 10, ts: str = "ts") -> DataFrame:
    """Rows of each day and a verdict on how far that is from what is expected."""
    off = F.abs(F.col("n") - expected)
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).withColumn("severity", F.when(off <= allowed, "ok").when(off > severe, "error").otherwise("warning"))


# The rule catalogue of the panel (type, column, low, high, severity, reason) by group.
_CATALOGUE = {
    "swissgrid_rules": """
range pos_sec_price -1000 15000 warning aFRR positive price outside historical range — possible market event or data error
range neg_sec_price -50000 1000 warning aFRR negative price outside historical range
non_negative pos_sec_vol_mw - - error Positive aFRR volume cannot be negative by definition
range pos_sec_vol_mw 0 1500 warning aFRR volume exceeds typical capacity
non_positive neg_sec_vol_mw - - error Negative aFRR volume cannot be positive by definition (sign convention)
range neg_sec_vol_mw -1500 0 warning Negative aFRR volume exceeds typical capacity
non_negative CH_DE_mw - - error Physical flow CH→DE cannot be negative — flow direction is encoded by separate columns
non_negative DE_CH_mw - - error Physical flow DE→CH cannot be negative — flow direction is encoded by separate columns
non_negative CH_FR_mw - - error Physical flow CH→FR cannot be negative
non_negative FR_CH_mw - - error Physical flow FR→CH cannot be negative
range CH_DE_mw 0 6000 error CH→DE flow exceeds physical interconnector capacity
range DE_CH_mw 0 6000 error DE→CH flow exceeds physical interconnector capacity
range CH_FR_mw 0 4500 error CH→FR flow exceeds physical interconnector capacity
range FR_CH_mw 0 4500 error FR→CH flow exceeds physical interconnector capacity
""",
    "entsoe_rules": """
range DE_WindSolar_Error -25000 25000 warning DE wind+solar forecast error outside historical range
range Sched_DE_CH 0 5000 error Scheduled DE→CH exceeds NTC capacity
range Sched_FR_CH 0 5000 error Scheduled FR→CH exceeds NTC capacity
range Sched_CH_IT 0 6000 error Scheduled CH→IT exceeds NTC capacity
range Sched_IT_CH 0 4500 error Scheduled IT→CH exceeds NTC capacity
range DA_Price_DE -500 4000 error DA price DE outside market price floor/ceiling — likely data error
range DA_Price_CH -500 4000 error DA price CH outside market price floor/ceiling
range CH_Load_Forecast 3000 12000 error CH load forecast outside physical demand range
non_negative CH_Pump_Gen - - error CH pumped storage generation cannot be negative
range CH_Pump_Gen 0 5000 warning CH pump generation exceeds installed capacity
""",
    "feature_rules": """
range abs_Unplanned_Flow 0 10000 warning Unplanned flow magnitude exceeds plausible range (DE-CH NTC + max schedule)
range Unplanned_Flow_FR_CH -10000 10000 warning Unplanned flow FR-CH outside plausible range
range minute 0 45 error Minute must be 0, 15, 30, or 45 for 15-min data
range is_turnover 0 1 error is_turnover must be binary 0 or 1
range price_spike_rolling 0 1 error Spike label must be binary 0 or 1
""",
}
_DERIVED = (
    ("DA_Price_Spread_DE_CH", "DA_Price_DE - DA_Price_CH", 0.01, "Spread is a derived field — must equal DE minus CH price exactly"),
    ("actual_net_DE_to_CH", "DE_CH_mw - CH_DE_mw", 0.1, "Net flow is a derived field — must equal directional difference"),
    ("Unplanned_Flow", "actual_net_DE_to_CH - Sched_DE_CH", 0.1, "Unplanned flow is the core causal variable — formula must hold exactly"),
)


def panel_rules() -> list[Rule]:
    """The rule catalogue of the energy panel: four groups of rules."""
    number = lambda x: None if x == "-" else float(x)
    rows = [(g, *x.split(" ", 5)) for g, text in _CATALOGUE.items() for x in text.strip().splitlines()]
    rules = [Rule(g, t, c, number(a), number(z), severity=s, reason=why) for g, t, c, a, z, s, why in rows]
    return rules + [Rule("consistency_rules", "derived_field", c, formula=f, tolerance=t, severity="error", reason=why) for c, f, t, why in _DERIVED]


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """``check_type, severity, n_issues`` of several checks: rows that aren't ok, by severity, of tables with a severity."""
    out = None
    for name, df in checks.items():
        one = df.where("severity <> 'ok'").groupBy("severity").agg(F.count("*").alias("n_issues")).select(F.lit(name).alias("check_type"), "severity", "n_issues")
        out = one if out is None else out.unionByName(one)
    return out
