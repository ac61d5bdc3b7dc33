"""Every query of the subpackage on the smallest data set, against its SQL where it has one."""

import glob
import os

import __spark_entry__ as entry_point
import duckdb
import pytest
from millrace.llm import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_registered():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as from '{path}'")
    want = connection.execute(ORACLES[name]).to_arrow_table()
    order = lambda t: sorted((sorted(r.items()) for r in t.to_pylist()), key=repr)
    assert order(got) == order(want)
    kinds = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    assert kinds(got) == kinds(want)
