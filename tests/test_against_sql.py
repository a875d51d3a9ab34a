"""Every registered query against its reference SQL in DuckDB, over whole tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from geovis.plans import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_a_reference():
    assert set(catalog.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(_plain(row[c]) for c in columns) for row in df.collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(_plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    assert _sorted(got) == _sorted(want)


def test_entry_has_a_row_per_site(spark):
    assert entry.entry(spark).count() == 50
