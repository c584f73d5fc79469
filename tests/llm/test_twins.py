"""The SQL twins of corpus operators give what the operators give, on the smallest tables."""

import duckdb
import pytest

from gridwatch.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_ngram_join", "op10_vectors", "op12_conversation_repair"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_repair_twin_with_nulls():
    """Null turns, roles and texts, and white space of all kinds, against the table of all cheapest edits."""
    import hashlib

    from test_repair import damage, expected, some_rows

    rows = [*some_rows(4, 80, 12), *((500, t, "user", "Same.") for t in range(12)), *((501, 1, "user", "Same.") for _ in range(6))]
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = {r[0]: r[1:] for r in con.sql(queries.oracle_sql()["op12_conversation_repair"]).fetchall()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected(v) if v else nothing for c, v in damage(rows).items()}
