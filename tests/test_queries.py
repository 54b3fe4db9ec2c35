"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lumenscan import queries as own


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def plain(frame, columns):
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted([tuple(round(v, 4) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", list(own.ORACLES))
def test_query(spark, data, db, name):
    found, expected = own.QUERIES[name](spark, data).toPandas(), db.sql(own.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert plain(found, columns) == plain(expected, columns)


def test_entry_and_registry(spark, data):
    import __spark_entry__

    assert set(own.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert 0 < own.QUERIES["hash_sample"](spark, data).count() < 300
