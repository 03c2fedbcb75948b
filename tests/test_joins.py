"""Joins that follow SQL in null keys and rounded times: against DuckDB and small cases."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.operators import relational as R
from tidewell.plans.inspect import formatted


@pytest.mark.parametrize("keys", [[1, 2, None, 2], []])
@pytest.mark.parametrize("values", [[], [2, 3, 3], [2, None], [None]])
def test_not_in_equals_sql(spark, keys, values):
    l, r = spark.createDataFrame([(k,) for k in keys], "k int"), spark.createDataFrame([(v,) for v in values], "v int")
    got = [x.k for x in R.not_in(l, r, F.col("k"), F.col("v")).collect()]
    l.createOrReplaceTempView("not_in_l"), r.createOrReplaceTempView("not_in_r")
    want = [x.k for x in spark.sql("SELECT k FROM not_in_l WHERE k NOT IN (SELECT v FROM not_in_r)").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["join_not_in_null_aware", "join_not_in_null_keys"])
def test_not_in_does_not_broadcast_values(spark, name):
    """With broadcasts of small tables off, only the row of counts is one; a null-aware join would be another whatever its size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = formatted(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_interval_rounds_as_its_sql(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    clicks = [0.0, 0.4, 0.5, 0.6, 1.5, 1.499999, 2.5]
    rows = [(i, at(s), 1, "click") for i, s in enumerate(clicks)] + [(100 + i, at(s), 1, "purchase") for i, s in enumerate([0.5, 0.51, 1.5, 2.49, *(86400 + s for s in (0.4, 0.5, 0.6, 1.5, 2.5))])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(catalog.oracle_sql()["join_interval"]).fetchall())
    assert sorted(map(tuple, catalog.queries()["join_interval"](spark, str(tmp_path)).collect())) == want and want


def test_lateral_window_has_the_order(spark):
    """The limit's window is ordered by price and key; a sort before a shuffle holds no order after it."""
    plan = formatted(catalog.queries()["join_lateral"](spark, "/root/testdata/sf0.001"))
    assert "rangepartitioning" not in plan
    window = plan[plan.rindex("row_number()") :].splitlines()[0]
    assert "o_totalprice" in window and "o_orderkey" in window
