"""Every query beside its SQL, on a small folder of tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
OWN = [n for n in entry.queries() if n in entry.contract.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    sql = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(got.columns)
    theirs = sorted((tuple(plain(v) for v in r) for r in sql.fetchall()), key=str)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_the_rest_does_not_import_the_training_data_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "lexhound")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f)).read(), f
