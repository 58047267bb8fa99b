"""Operators whose whole result SQL can state, against DuckDB on the same tables."""

import duckdb
import pytest

from spendsignals.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    relation = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    rows = lambda x: sorted((tuple(r) for r in x), key=str)
    assert rows(got.select(*columns).collect()) == rows(con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
