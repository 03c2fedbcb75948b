"""Plans are the ones wanted: pruned scans, pushed filters, early limits, no pair joins."""

import datetime

from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.operators import relational as R
from tidewell.plans.inspect import operators, pushed_filters, read_schemas

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)


def test_scan_reads_and_pushes(spark):
    df = plan(spark, "scan_filter_project")
    assert set(read_schemas(df)[0]) == {"l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}
    assert "l_shipdate" in pushed_filters(df)[0] and "l_quantity" in pushed_filters(df)[0]


def test_partial_aggregation_before_one_shuffle(spark):
    found = operators(plan(spark, "agg_pricing_summary"))
    assert found["HashAggregate"] == 2 and found["Exchange"] == 1


def test_salted_sum_reads_what_it_sums(spark):
    assert set(read_schemas(plan(spark, "agg_salted_hot_key"))[0]) == {"l_returnflag", "l_quantity"}


def test_top_k_is_cut_before_the_shuffle(spark):
    assert operators(plan(spark, "top_k_per_group"))["WindowGroupLimit"] == 2
    assert operators(plan(spark, "sort_limit"))["TakeOrderedAndProject"] == 1


def test_time_joins_build_no_cartesian_product(spark):
    for name in ("join_interval", "join_as_of"):
        found = operators(plan(spark, name))
        assert not found["CartesianProduct"] and not found["BroadcastNestedLoopJoin"], name


def test_no_python_in_relational_queries(spark):
    for name in catalog.oracle_sql():
        if name.startswith(("join_", "agg_", "window_", "set_", "fn_", "sort_")):
            assert not [o for o in operators(plan(spark, name)) if "Python" in o or "Arrow" in o or "Pandas" in o], name


def test_as_of_edges(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([("a", at(5), 10), ("a", at(1), 11), ("b", at(5), 12), (None, at(5), 13)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(1), 1, 1.0), ("a", at(4), 2, 2.0), ("a", at(5), 3, None)], "k string, ts timestamp_ntz, id int, v double")
    got = {x.id: x.last for x in R.as_of(left, right, "k", "ts", "v", "last", "id").collect()}
    assert got == {10: 2.0, 11: 1.0, 12: None, 13: None}


def test_interval_join_against_pairs(spark):
    import random

    r = random.Random(1)
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, r.randrange(3), base + datetime.timedelta(seconds=r.randrange(4000)), r.random() < 0.5) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz, left boolean")
    got = {(x.l_id, x.r_id) for x in R.interval_join(d.where("left"), d.where("not left"), ["k"], "ts", 300, ["id"], ["id"]).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] and not b[3] and a[1] == b[1] and 0 < (b[2] - a[2]).total_seconds() <= 300}
    assert got == want


def test_interval_join_to_the_microsecond(spark):
    base = datetime.datetime(1969, 12, 31, 23, 59, 50)  # cells of times before 1970 too
    at = lambda s: base + datetime.timedelta(seconds=s)
    left = spark.createDataFrame([(1, 1, at(0.9)), (2, 1, at(8))], "id int, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(11, 1, at(1.6)), (12, 1, at(5.9)), (13, 1, at(6.3)), (14, 1, at(0.9)), (15, 1, at(13.0)), (16, 1, at(13.000001))], "id int, k int, ts timestamp_ntz")
    got = {(x.l_id, x.r_id) for x in R.interval_join(left, right, ["k"], "ts", 5, ["id"], ["id"]).collect()}
    assert got == {(1, 11), (1, 12), (2, 15)}


def test_as_of_over_many_cells_of_one_key(spark):
    import random

    r = random.Random(3)
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, r.choice(["hot"] * 9 + ["b", None]), base + datetime.timedelta(seconds=r.randrange(40_000)), r.random() < 0.3, r.choice([1.0, 2.0, None])) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, l boolean, v double")
    got = {x.id: x.last for x in R.as_of(d.where("l").select("id", "k", "ts"), d.where("not l"), "k", "ts", "v", "last", "id", cell=600).collect()}
    for i, k, ts, l, _ in rows:
        if l:
            before = [(x[2], x[0], x[4]) for x in rows if not x[3] and x[1] == k and x[4] is not None and (x[2], x[0]) < (ts, i)]
            assert got[i] == (max(before)[2] if before else None)


def test_containment_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a cat sat"), (2, "dog"), (3, None), (4, "")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "cat"), (2, "a"), (3, ""), (4, None), (5, "dog"), (6, "dogs")], "item_id int, text string")
    for most in (10_000, 1):
        monkeypatch.setattr(R, "ITEMS", most)
        assert sorted(map(tuple, R.containment_join(docs, items, ["doc_id"], ["item_id"]).collect())) == [(1, 1), (1, 2), (2, 5)]


def test_not_in_with_nulls_gives_nothing(spark):
    spark.createDataFrame([(1,), (2,)], "a int").createOrReplaceTempView("na_left")
    spark.createDataFrame([(1,), (None,)], "b int").createOrReplaceTempView("na_right")
    assert spark.sql("SELECT a FROM na_left WHERE a NOT IN (SELECT b FROM na_right)").count() == 0
    assert spark.sql("SELECT a FROM na_left WHERE a NOT IN (SELECT b FROM na_right WHERE b IS NOT NULL)").count() == 1


def test_salted_sum_equals_plain(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("decimal(18,4)").alias("v"))
    assert {(x.k, x.s) for x in R.salted_sum(d, "k", F.col("v"), "s").collect()} == {(x.k, x.s) for x in d.groupBy("k").agg(F.sum("v").alias("s")).collect()}


def test_empty_tables(spark):
    left = spark.createDataFrame([], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([], "k string, ts timestamp_ntz, id int, v double")
    assert R.as_of(left, right, "k", "ts", "v", "last", "id").count() == 0
    assert R.top_per_group(left, ["k"], [F.col("id")], 2).count() == 0
