"""The operators' queries against DuckDB where SQL can express them."""

import duckdb
import pytest

from webloom.llm import queries as Q


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = con.execute(Q.ORACLES[name])
    assert got == rows([d[0] for d in c.description], c.fetchall())


def test_a_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in Q.QUERIES if n.startswith("op")] == list(range(1, 11)) and "pipeline" in Q.QUERIES
