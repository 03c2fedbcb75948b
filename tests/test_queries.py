"""Every catalogued query against DuckDB on the smallest tables."""

import os
import pathlib

import duckdb
import pytest

from tidewell import catalog
from tidewell.sources.tables import NAMES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        p = f"{SF}/{n}.parquet"
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{p + '/*.parquet' if pathlib.Path(p).is_dir() else p}'")
    return c


def plain(rows):
    return sorted((tuple(None if v is None else str(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert plain(df.select(*order).collect()) == plain(want.select(*(f'"{c}"' for c in order)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
