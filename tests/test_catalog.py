"""Every registered query against its SQL on the smallest data set."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tallymart.catalog.oracles import ORACLES
from tallymart.catalog.queries import QUERIES
from tools.check import plain, rows_of

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="sample data is not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


# The training-data queries have their own tests beside them.
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, str(FOLDER))
    rows = frame.collect()
    sql = ORACLES.get(name)
    if sql is None:
        assert frame.columns
        return
    result = con.sql(sql)
    assert sorted(frame.columns) == sorted(result.columns)
    assert rows_of(frame.columns, rows) == rows_of(result.columns, result.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["seller_link", "date", "order_amount"]


def test_plain_values():
    assert [plain(x) for x in (None, 1.50, 2, True)] == ["None", "1.5", "2", "True"]
