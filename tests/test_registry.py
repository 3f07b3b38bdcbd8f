"""Every registered query of the relational surface against DuckDB, on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

from lakewright.queries import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.4f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    expected = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize(("name", "whole"), [("expr_arith", "lineitem"), ("expr_modulo", "orders"), ("fn_datediff", "lineitem JOIN orders ON l_orderkey = o_orderkey")])
def test_whole_table(spark, duck, name, whole):
    assert registry.queries()[name](spark, DATA).count() == duck.sql(f"SELECT COUNT(*) FROM {whole}").fetchall()[0][0]
