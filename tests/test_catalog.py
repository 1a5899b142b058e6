"""Every registered query of the engine against its SQL in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from spanweave import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def cell(x):
    return round(x, 4) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_and_sql_agree(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql()[name]
    names = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in names) for r in df.collect())
    result = duck.sql(sql)
    assert sorted(result.columns) == names
    want = Counter(tuple(map(cell, r)) for r in result.project(", ".join(f'"{c}"' for c in names)).fetchall())
    assert got == want, (len(got), len(want), list((got - want).items())[:3], list((want - got).items())[:3])
    assert got
