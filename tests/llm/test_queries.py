"""Queries of the subpackage that have SQL give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "clicks", "clients"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = QUERIES[name](spark, data)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(c.execute(f"SELECT * FROM ({ORACLE_SQL[name]}) LIMIT 0").df().columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))
