import os

import duckdb
import pytest

from scriptorium import queries

SF = "/root/testdata/sf0.001"
SLOW = {"dedup_append", "append_numbering", "stream_ingest"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", [n for n in queries.ORACLES if n not in SLOW])
def test_same_rows_as_sql(spark, duck, name):
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    sql = duck.execute(queries.ORACLES[name]())
    place = [[d[0] for d in sql.description].index(c) for c in columns]
    ours = sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=str)
    assert ours == sorted((tuple(r[i] for i in place) for r in sql.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
