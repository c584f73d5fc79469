"""Failed checks with their first rows: counts and a bounded list of rows for each check, from one scan.

Only rows that fail something leave the scan. Each task keeps a count and the ``n`` least failing rows of each
check, and sends on just these; the lists of all tasks are cut again the same way. Rows are ordered by the ``order`` columns,
nulls first, which should tell rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import SAMPLES, Field, Rule, usable

Check = tuple[Column, Column]


def first_failures(df: DataFrame, checks: list[Check], order: list[str], n: int = SAMPLES) -> DataFrame:
    """``check, n_failures, place, value`` and the ``order`` columns: the first ``n`` rows that fail each check.

    A check is where a row fails (null counts as passed) and what is shown of the row. Checks that no row fails have no rows.
    """
    cells = F.array(*(F.when(bad, F.struct(F.lit(i).alias("check"), shown.cast("string").alias("value"))) for i, (bad, shown) in enumerate(checks)))
    hits = df.select(*order, F.explode(cells).alias("x")).where("x is not null").select("x.check", "x.value", *order)
    schema = hits.withColumn("n_failures", F.lit(0).cast("bigint")).schema
    keys, many = [("check", "ascending"), *((c, "ascending") for c in order)], len(checks)

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        check = rows.column("check").to_numpy()
        return rows.take(np.flatnonzero(np.arange(len(check)) - np.searchsorted(check, check) < n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = np.zeros(many, dtype=np.int64), None
        for b in batches:
            counts += np.bincount(b.column("check").to_numpy(), minlength=many)
            own = pa.Table.from_batches([b])
            best = cut(own if best is None else pa.concat_tables([best, own]))
        if best is not None:
            failed = np.flatnonzero(counts)
            total = pa.Table.from_arrays([pa.array(failed, pa.int32()), *(pa.nulls(len(failed), f.type) for f in list(best.schema)[1:])], schema=best.schema)
            both = pa.concat_tables([total, best])
            yield from both.append_column("n_failures", pa.array(np.concatenate([counts[failed], np.zeros(len(best), dtype=np.int64)]))).combine_chunks().to_batches()

    # at most a count and n rows for each check and task
    some = hits.mapInArrow(run, schema)
    counted = some.withColumn("total", F.sum("n_failures").over(W.partitionBy("check"))).where("n_failures = 0")
    placed = counted.withColumn("place", F.row_number().over(W.partitionBy("check").orderBy(*(F.asc_nulls_first(c) for c in order), "value"))).where(F.col("place") <= n)
    return placed.select("check", F.col("total").alias("n_failures"), "place", "value", *order)


def failure_rows(df: DataFrame, fields: list[Field], order: list[str], n: int = SAMPLES, least_rows: int = 0, required: list[str] | None = None, other: DataFrame | None = None) -> DataFrame:
    """``check_type, column_name, check_name, n_failures, place, value`` and the ``order`` columns of every failed check.

    ``schema`` checks show the first rows that fail; a missing column or another type fails every row. ``rows`` (fewer than
    ``least_rows``) and ``columns`` (``required`` ones that are missing, and those in one of two tables only) concern the
    table: they have one row each, without place and key.
    """
    types, names, checks = dict(df.dtypes), [], []
    for f in fields:
        c = F.col(f.name) if f.name in types else F.lit(None)
        tests: dict[str, Column] = {"present": F.lit(True)}
        if f.name in types:
            tests = {"type": F.lit(True)} if types[f.name] != f.type else {}
            tests |= {} if f.nullable else {"not_null": c.isNull()}
            tests |= {} if f.low is None else {"at_least": c < f.low}
            tests |= {} if f.high is None else {"at_most": c > f.high}
        names += [("schema", f.name, k) for k in tests]
        checks += [(bad, c) for bad in tests.values()]
    whole = [("columns", c, "missing", 1, None) for c in required or [] if c not in types]
    if other is not None:
        whole += [("columns", c, "only_left", 1, types[c]) for c in df.columns if c not in other.columns]
        whole += [("columns", c, "only_right", 1, t) for c, t in other.dtypes if c not in types]
    if least_rows and (found := df.limit(least_rows).count()) < least_rows:
        whole.append(("rows", "*", "at_least", least_rows - found, str(found)))
    spark, keys = df.sparkSession, [F.lit(None).cast(types[c]).alias(c) for c in order]
    out = spark.createDataFrame(whole, "check_type string, column_name string, check_name string, n_failures bigint, value string")
    out = out.select("check_type", "column_name", "check_name", "n_failures", F.lit(None).cast("int").alias("place"), "value", *keys)
    if not checks:
        return out
    named = spark.createDataFrame([(i, *x) for i, x in enumerate(names)], "check int, check_type string, column_name string, check_name string")
    rows = first_failures(df, checks, order, n).join(F.broadcast(named), "check")
    return rows.select(*out.columns).unionByName(out)


def _shown(r: Rule) -> Column:
    """What a sample shows of a row: the value, both values, or what was expected and what was found."""
    if r.type == "derived_field":
        return F.format_string("expected %s, actual %s", F.expr(r.formula).cast("string"), F.col(r.column).cast("string"))
    if r.other:
        return F.format_string("%s, %s", F.col(r.column).cast("string"), F.col(r.other).cast("string"))
    return F.col(r.column)


def _told(r: Rule) -> str:
    """The reason with the rule's numbers."""
    more = {"range": f" (range: [{r.low}, {r.high}])", "not_simultaneous": f" (tolerance: {r.tolerance} MW)", "derived_field": f" (formula: {r.formula}, tolerance: {r.tolerance})"}
    return r.reason + more.get(r.type, "")


def violation_report(df: DataFrame, rules: list[Rule], index: str, groups: list[str] | None = None, n: int = SAMPLES) -> DataFrame:
    """``rule_type, severity, columns, n_violations, sample_values, sample_indices, reason, rule_config``: every broken rule with
    the first ``n`` rows by ``index`` that break it. A formula that can't be read gives a warning without samples."""
    good, bad = usable(df, rules, groups)
    spark, kind = df.sparkSession, dict(df.dtypes)[index]
    about = "check int, rule_type string, severity string, columns array<string>, reason string, rule_config map<string,string>"
    config = lambda r: {k: str(v) for k, v in vars(r).items() if v not in (None, "")}
    names = ["rule_type", "severity", "columns", "n_violations", "sample_values", "sample_indices", "reason", "rule_config"]
    rows = [(-1, r.type, "warning", r.needs, f"Could not evaluate formula '{r.formula}'", config(r)) for r in bad]
    failed = spark.createDataFrame(rows, about).withColumns({"n_violations": F.lit(0).cast("bigint"), "sample_values": F.array().cast("array<string>"), "sample_indices": F.array().cast(f"array<{kind}>")}).select(*names)
    if not good:
        return failed
    told = spark.createDataFrame([(i, r.type, r.severity, r.needs, _told(r), config(r)) for i, r in enumerate(good)], about)
    found = first_failures(df, [(r.broken(), _shown(r)) for r in good], [index], n)
    cell = F.struct("place", "value", index)
    lists = found.groupBy("check").agg(F.first("n_failures").alias("n_violations"), F.array_sort(F.collect_list(cell)).alias("s"))  # n rows at most
    lists = lists.withColumns({"sample_values": F.transform("s", lambda x: x["value"]), "sample_indices": F.transform("s", lambda x: x[index])})
    return lists.join(F.broadcast(told), "check").select(*names).unionByName(failed)
