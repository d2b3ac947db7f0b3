"""The catalog against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from seekspark.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"

def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    frame = contract.queries()[name](spark, FOLDER)
    relation = con.sql(contract.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(
        repr(tuple(r[i] for i in places)) for r in relation.fetchall()
    )
