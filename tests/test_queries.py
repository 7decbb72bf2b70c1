"""Every sheet query against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from gridloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
            return float(v)
        return str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, oracle, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    want = oracle.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    wanted = oracle.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(rows) == plain(wanted)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
