"""Every training-data query that has a DuckDB form, on the smallest tables; the others run."""

import os
import pathlib

import duckdb
import pytest

from tidewell.llm import registry
from tidewell.sources.tables import NAMES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck():
    c = duckdb.connect()
    for n in NAMES:
        p = f"{SF}/{n}.parquet"
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{p + '/*.parquet' if pathlib.Path(p).is_dir() else p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    df = registry.queries()[name](spark, SF)
    want = duck().sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(df.select(*order).collect()) == plain(want.select(*(f'"{c}"' for c in order)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0
