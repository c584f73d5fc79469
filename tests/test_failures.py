"""Failed checks with their first rows against plain Python, and the rule report."""

import random

import pytest

from gridwatch.operators import failures, quality
from gridwatch.operators.quality import Field, Rule

SCHEMA = "k bigint, a double, b int, check string, value int"


def rows(n=700, seed=2):
    rng = random.Random(seed)
    out = [(i, rng.choice([None, rng.uniform(-5, 5)]), rng.choice([None, 0, 1, 9]), "x", 1) for i in range(n)]
    return out + [(None, -7.0, 3, None, None), (None, 7.0, None, None, None)]


def first(found, n):
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0))[:n]


@pytest.mark.parametrize("n", [1, 5])
def test_counts_and_first_rows(spark, n):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    fields = [Field("a", nullable=False, low=-4, high=4), Field("b", type="int", low=0, high=8), Field("gone"), Field("k", type="int")]
    got = failures.failure_rows(df, fields, ["k"], n, least_rows=1000, required=["a", "far"], other=df.drop("b")).collect()
    bad = {("a", "not_null"): lambda r: r[1] is None, ("a", "at_least"): lambda r: r[1] is not None and r[1] < -4, ("a", "at_most"): lambda r: r[1] is not None and r[1] > 4}
    bad |= {("b", "at_most"): lambda r: r[2] is not None and r[2] > 8, ("gone", "present"): lambda r: True, ("k", "type"): lambda r: True}
    want = {}
    for check, test in bad.items():
        hits = [r for r in data if test(r)]
        want[check] = (len(hits), [r[0] for r in first(hits, n)])
    seen = {}
    for r in sorted((r for r in got if r["check_type"] == "schema"), key=lambda r: r["place"]):
        seen.setdefault((r["column_name"], r["check_name"]), (r["n_failures"], []))[1].append(r["k"])
    assert seen == want
    whole = {tuple(r)[:4] for r in got if r["check_type"] != "schema"}
    assert whole == {("columns", "far", "missing", 1), ("columns", "b", "only_left", 1), ("rows", "*", "at_least", 1000 - len(data))}


def test_tables_without_failures(spark):
    df = spark.createDataFrame([(1, 2.0, 1, "", 1)], SCHEMA)
    assert failures.failure_rows(df, [Field("a", low=0)], ["k"]).count() == 0
    assert failures.failure_rows(df.limit(0), [Field("a", nullable=False), Field("gone")], ["k"]).count() == 0
    assert failures.failure_rows(df, [], ["k"], required=["zzz"]).count() == 1


def test_report_of_rules(spark):
    df = spark.createDataFrame(rows(), SCHEMA).where("k is not null")
    rules = [Rule("g", "range", "a", -4.0, 4.0, severity="error", reason="far out"), Rule("g", "not_simultaneous", "a", other="b", tolerance=0.5, reason="both"), Rule("h", "derived_field", "a", formula="b * 2", tolerance=1, reason="sum")]
    rules += [Rule("h", "derived_field", "a", formula="nothing * 2", reason="unread"), Rule("h", "non_negative", "absent"), Rule("h", "non_negative", "b")]
    got = {r["reason"]: r for r in failures.violation_report(df, rules, "k").collect()}
    assert set(got) == {"far out (range: [-4.0, 4.0])", "both (tolerance: 0.5 MW)", "sum (formula: b * 2, tolerance: 1)", "Could not evaluate formula 'nothing * 2'"}
    far = got["far out (range: [-4.0, 4.0])"]
    hits = [r for r in rows() if r[0] is not None and r[1] is not None and not -4 <= r[1] <= 4]
    assert far["n_violations"] == len(hits) and far["sample_indices"] == [r[0] for r in hits[:5]] and [float(v) for v in far["sample_values"]] == [r[1] for r in hits[:5]]
    assert far["columns"] == ["a"] and far["rule_config"] == {"group": "g", "type": "range", "column": "a", "low": "-4.0", "high": "4.0", "tolerance": "0.0", "severity": "error", "reason": "far out"}
    assert got["both (tolerance: 0.5 MW)"]["columns"] == ["a", "b"] and got["sum (formula: b * 2, tolerance: 1)"]["sample_values"][0].startswith("expected ")
    assert [r["n_violations"] for r in failures.violation_report(df, rules, "k", groups=["h"]).where("size(sample_values) = 0").collect()] == [0]


def test_catalogue_has_reasons():
    rules = quality.panel_rules()
    assert len(rules) == 32 and all(r.reason for r in rules) and {r.group for r in rules} == {"swissgrid_rules", "entsoe_rules", "feature_rules", "consistency_rules"}
    assert next(r for r in rules if r.column == "minute").reason == "Minute must be 0, 15, 30, or 45 for 15-min data"
