"""Every catalogued query against its SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quire.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    else:
        assert rows


def test_pair_join_is_an_equi_join(spark):
    plan = QUERIES["overlap_histogram"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_scans_read_only_what_is_used(spark):
    plan = QUERIES["region_type_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_returnflag" not in plan
