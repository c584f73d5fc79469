"""The driver's entry points hang together, with and without the corpus operators."""

import __spark_entry__ as entry


def test_twins_have_queries():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


def test_without_corpus_operators(monkeypatch):
    monkeypatch.setattr(entry, "llm", None)
    names = set(entry.queries())
    assert "spike_quintile_lift" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["bucket", "spike_probability", "n", "avg_flow", "avg_price", "ratio_vs_q1"] and out.count() == 5
