"""Registered queries against their DuckDB twins on the smallest tables (full sweep with
LECTERN_FULL_ORACLE=1 also runs sf0.01)."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_CHECK, SF_SMALL
from lectern.sources.tables import TABLES

QUERIES = entry.queries()
SQL = entry.oracle_sql()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if hasattr(v, "tolist"):
        return v.tolist()
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)),
                        key=repr)


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    dirs = [SF_SMALL] + ([SF_CHECK] if os.environ.get("LECTERN_FULL_ORACLE") else [])
    for sf in dirs:
        got = QUERIES[name](spark, sf).toPandas()
        exp = duck(sf).execute(SQL[name]).df()
        assert rows(got) == rows(exp), f"{name} at {sf}"


def test_every_query_has_sql_or_is_rows_only(spark):
    rows_only = {q for q in set(QUERIES) - set(SQL) if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert not rows_only


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
