"""Every query with SQL gives DuckDB's rows on the smallest tables; all others give rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from quarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        v = v.item()
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(frame):
    return sorted((tuple(map(value, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name not in catalogue.SQL:
        assert len(got.columns)
        return
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
