"""Every query of the engine that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strataloom.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, FOLDER).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())
