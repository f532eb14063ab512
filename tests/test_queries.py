"""Every query against its SQL on the smallest tables, and without the optional subpackage."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = con.sql(SQL[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


#: Without SQL and without rows on the smallest tables; their operators are tested on made-up rows.
NO_ROWS = {"sign_conflicts"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    """Rows come out, the same ones whatever the partitioning."""
    first = QUERIES[name](spark, sf)
    rows = sorted((repr(tuple(r)) for r in first.collect()))
    assert bool(rows) is (name not in NO_ROWS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted((repr(tuple(r)) for r in QUERIES[name](spark, sf).collect())) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:1] == ["run_name"] and df.count() > 0


def test_the_rest_stands_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['tabulith.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('p1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
