"""The sorts of queries.py over whole tables, without their limits: every row, in order."""

import os

import pytest

from quillframe import LazyFrame, col, scan_parquet

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("ascending", [True, False])
def test_nulls(spark, ascending):
    keys = [3, None, -1, 7, None, 3, 0]
    f = LazyFrame(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3))
    want = [-1, 0, 3, 3, 7, None, None]
    assert [r["k"] for r in f.sort(["k"], ascending).df.collect()] == (want if ascending else want[::-1])


@pytest.mark.parametrize("ascending", [True, False])
def test_whole_lineitem(spark, ascending):
    f = scan_parquet(f"{SF}/lineitem.parquet", spark).with_column("k", (col("l_orderkey") + 0) / (col("l_linenumber") - 1)).select(["k"])
    keys = [r["k"] for r in f.df.collect()]
    want = sorted(keys, key=lambda k: (k is None, k or 0), reverse=not ascending)
    assert None in keys and len(set(keys)) > 100
    assert [r["k"] for r in f.sort(["k"], ascending).df.collect()] == want


def test_whole_part(spark):
    f = scan_parquet(f"{SF}/part.parquet", spark)
    rows = [tuple(r) for r in f.df.collect()]
    at = [f.df.columns.index(c) for c in ("p_brand", "p_partkey")]
    assert [tuple(r) for r in f.sort(["p_brand", "p_partkey"]).df.collect()] == sorted(rows, key=lambda r: [r[i] for i in at])
