"""Every query with SQL gives the same rows as its SQL on the smallest tables."""

import os

import duckdb
import pytest

from marlstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_same_as_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))
