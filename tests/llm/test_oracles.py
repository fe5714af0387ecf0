"""The queries of the training-data operators beside their SQL."""

import os

import duckdb
import pytest

from lexhound.llm.contract import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    sql = con.execute(ORACLES[name])
    columns = [d[0] for d in sql.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(got.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    theirs = sorted((tuple(map(plain, r)) for r in sql.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == theirs and theirs
