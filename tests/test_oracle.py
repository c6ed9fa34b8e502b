"""Every registered query against its DuckDB twin on sf0.001 (the driver's
gate runs the same comparison on sf0.01)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.catalog import QUERIES as CATALOG
from tools.check_oracle import TABLES, row_hash

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_of_the_library_has_a_twin():
    """Queries that are added beside the library's may have none; they are
    tested where they are kept."""
    assert set(CATALOG) <= set(ORACLE) and set(ORACLE) <= set(QUERIES)


#: What DuckDB's types of a twin's columns are in Spark.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, key):
    found = QUERIES[key](spark, SF)
    got = found.toPandas()
    answer = con.execute(ORACLE[key])
    types = {c[0]: str(c[1]) for c in answer.description}
    want = answer.df()
    assert sorted(got.columns) == sorted(want.columns)
    if key in CATALOG:
        assert list(got.columns) == list(want.columns)
        assert {c: t for c, t in found.dtypes} == {c: TYPES[t] for c, t in types.items()}
    assert len(got) == len(want)
    assert row_hash(got)[0] == row_hash(want)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["Country", "Country_ID", "Year", "Annual_Sales", "Annual_Profit"]
    assert df.count() > 0
