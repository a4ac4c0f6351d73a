"""Every query that has SQL, against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    made = duck.execute(SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows(names, made.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) == len(got)
    for a, b in zip(want, got, strict=True):
        assert a == b or a == pytest.approx(b, rel=1e-12)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
