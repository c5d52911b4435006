"""Every market query against its SQL in another engine, on the smallest tables."""

import math

import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def cells(rows, columns, order):
    at = [columns.index(c) for c in order]

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v).replace(" 00:00:00", "")

    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


def names():
    from tideline import plans

    return sorted(plans.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, oracle, name):
    from tideline import plans

    df = plans.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in plans.ORACLE_SQL:
        got = oracle.execute(plans.ORACLE_SQL[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert cells(rows, df.columns, sorted(columns)) == cells(got.fetchall(), columns, sorted(columns))


def test_entry_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(s) > 180; print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
