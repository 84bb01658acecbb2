"""Every query against its SQL in DuckDB on the small tables."""

import decimal
import os

import duckdb
import pytest

from quarry import queries
from quarry.operators import items

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=repr)
    if name not in queries.oracle_sql():
        assert rows
        return
    got = duck.sql(queries.oracle_sql()[name])
    at = [got.columns.index(c) for c in cols]
    assert sorted(got.columns) == cols
    assert rows == sorted([tuple(norm(r[k]) for k in at) for r in got.fetchall()], key=repr)


def test_loose_name_match_reads_all_customers(spark):
    """Any customer can be matched, and a name that several share matches none."""
    got = {(r.s_suppkey, r.c_custkey) for r in queries.queries()["loose_name_match"](spark, SF).collect()}
    assert got == {(s, s) for s in range(spark.read.parquet(f"{SF}/supplier.parquet").count())}
    several = spark.createDataFrame([("1", 1), ("1", 2), ("2", 3)], "k string, r int")
    assert [(x.k, x.r) for x in items.loose_match(several.select("k").distinct(), several, "k").collect()] == [("2", 3)]


def test_union_precedence_reads_whole_tables(spark):
    """Every order has a row, from the second adapter just where no line has its key."""
    got = {r.k: r.adapter for r in queries.queries()["union_precedence_whole"](spark, SF).collect()}
    lines = {r.l_orderkey for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()}
    orders = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    assert got == {k: int(k not in lines) for k in orders | lines} and set(got.values()) == {0, 1}
