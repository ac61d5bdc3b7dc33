"""Every registered query against its SQL, on the smallest data set."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_point
from millrace.catalog import all_oracles, all_queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"create view {name} as from '{path}'")
    return connection


def canonical(table):
    columns = sorted(table.schema.names)
    text = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else repr(v)
    return columns, sorted(tuple(text(row[c]) for c in columns) for row in table.to_pylist())


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).to_arrow_table()
        assert canonical(got) == canonical(want)
        kind = lambda t, c: str(t.schema.field(c).type).replace("large_", "")
        assert {c: kind(got, c) for c in got.schema.names} == {
            c: kind(want, c) for c in want.schema.names}
    else:
        assert got.num_rows > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 2
