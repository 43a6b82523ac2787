"""Every query beside its SQL on the smallest tables, compared as the driver does it."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(f)[:-8]}\" AS SELECT * FROM '{f}'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, db, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    ours = Counter(plain(r) for r in df.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    assert ours == Counter(plain(r) for r in db.execute(f"SELECT {listed} FROM ({SQL[name]})").fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark, small):
    assert entry.entry(spark).columns == ["root_id", "snapshot_no", "path", "status"]
