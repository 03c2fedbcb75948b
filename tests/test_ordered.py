"""Ranks, running sums, quantiles and joins without equal keys: against plain windows and brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import ordered as O
from tidewell.operators import relational as R
from tidewell.plans.inspect import formatted, operators


def hot(spark, seed, n=600, ties=12):
    r = random.Random(seed)
    rows = [(i, r.choice(["hot"] * 9 + ["b", None]), r.choice([None, *range(ties)]), r.choice([None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, k string, o int, v int").repartition(5)


def same(a, b, cols):
    rows = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*cols).collect()), key=str)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks_equal_the_window(spark, keys):
    d = hot(spark, 1)
    got = O.ranks(d, keys, ["o"], ["id"], tiles=7)
    w = Window.partitionBy(*keys).orderBy(F.col("o").asc_nulls_first())
    t = Window.partitionBy(*keys).orderBy(F.col("o").asc_nulls_first(), "id")
    want = d.select("*", F.row_number().over(t).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(7).over(t).alias("tile"), F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"))
    same(got, want, ["id", "k", "rn", "rk", "dr", "tile", "pr", "cd"])
    few = O.ranks(d.where("id < 3"), keys, ["o"], ["id"], tiles=7)
    assert {x.tile for x in few.collect()} <= {1, 2, 3}
    assert O.ranks(d.limit(0), keys, ["o"], ["id"]).count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums_equal_the_window(spark, keys):
    d = hot(spark, 2).withColumn("m", F.col("v").cast("decimal(18,4)") / 3)
    got = O.running(d, keys, ["o", "id"], {"before": F.col("v"), "n": F.lit(1), "exact": F.col("m")})
    w = Window.partitionBy(*keys).orderBy(F.col("o").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, -1)
    want = d.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"), F.count("*").over(w).alias("n"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("exact"))
    same(got, want, ["id", "before", "n", "exact"])


def test_no_task_holds_the_whole_order(spark):
    """The rows are read in parts: no Exchange to a single partition above them."""
    got = O.ranks(hot(spark, 3), [], ["o"], ["id"])
    assert "SinglePartition" not in formatted(got)


@pytest.mark.parametrize("most", [10, 200])
def test_quantiles_of_hot_groups(spark, most):
    r = np.random.default_rng(4)
    kinds = {"even": r.random(3000), "steep": 10.0 ** r.integers(-300, 300, 2500), "ties": r.integers(0, 3, 2000) / 2, "one": np.full(700, 2.5), "small": np.array([3.0, 1.0]), None: r.normal(size=900), "signs": np.concatenate([-(10.0 ** r.integers(0, 9, 400)), [0.0] * 300])}
    rows = [(k, float(x)) for k, v in kinds.items() for x in v] + [("even", None), ("none", None)]
    d = spark.createDataFrame(rows, "k string, x double").repartition(4)
    shares = [0.0, 0.01, 0.5, 0.937, 1.0]
    got = {(x.k, x.share): x.quantile for x in O.exact_quantiles(d, "k", "x", shares, most=most).collect()}
    assert set(got) == {(k, s) for k in kinds for s in shares}
    for (k, s), q in got.items():
        v = np.sort(kinds[k])
        at = s * (len(v) - 1)
        a, b = v[int(np.floor(at))], v[int(np.ceil(at))]
        assert q == pytest.approx(a + (b - a) * (at - np.floor(at)), rel=1e-12), (k, s)
    assert O.exact_quantiles(d.limit(0), "k", "x", shares).count() == 0


def test_quantiles_with_a_sketch_that_errs(spark, monkeypatch):
    """A margin far too narrow: counts find the right side, and the search goes on there."""
    monkeypatch.setattr(O, "MARGIN", 0.0)
    monkeypatch.setattr(O, "SKETCH", 40)
    v = np.random.default_rng(5).permutation(1500) / 7
    d = spark.createDataFrame([("a", float(x)) for x in v], "k string, x double")
    got = {x.share: x.quantile for x in O.exact_quantiles(d, "k", "x", [0.5], most=200).collect()}
    assert got == pytest.approx({0.5: np.quantile(v, 0.5)}, rel=1e-12)


# --- joins without equal keys ---------------------------------------------------------------------


@pytest.mark.parametrize("key", [[], ["k"]])
def test_overlaps_against_pairs(spark, key):
    r = random.Random(6)
    base = datetime.datetime(1970, 1, 2)
    at = lambda s: base + datetime.timedelta(seconds=s)
    rows = []
    for i in range(150):
        s, n = r.randrange(-90_000, 90_000), r.choice([0, 1, 59, 60, 61, 600, 4000, 60_000, 10**9])
        rows.append((i, r.choice("ab"), at(s), at(s + n)))
    rows += [(900, "a", at(5), None), (901, None, at(0), at(9)), (902, "a", None, at(9)), (903, "a", at(9), at(3)), (904, "b", at(-(10**9)), at(10**9)), (905, "a", at(0), at(60)), (906, "a", at(60), at(120))]
    d = spark.createDataFrame(rows, "id int, k string, s timestamp_ntz, e timestamp_ntz")
    got = [(x.l_id, x.r_id) for x in R.overlap_join(d, d, key, "s", "e", ["id"], ["id"], cell=60).collect()]
    live = [x for x in rows if x[2] and x[3] and x[2] < x[3] and (x[1] or not key)]
    want = {(a[0], b[0]) for a in live for b in live if (not key or a[1] == b[1]) and a[2] < b[3] and b[2] < a[3]}
    assert len(got) == len(set(got)) and set(got) == want and (905, 906) not in want


def test_overlaps_are_an_equi_join(spark):
    d = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2))], "id int, s timestamp_ntz, e timestamp_ntz")
    found = operators(R.overlap_join(d, d, [], "s", "e", ["id"], ["id"]))
    assert not found["BroadcastNestedLoopJoin"] and not found["CartesianProduct"]
    assert R.overlap_join(d.limit(0), d, [], "s", "e", ["id"], ["id"]).count() == 0


@pytest.mark.parametrize("block", [10_000, 5])
def test_two_inequalities_against_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(R, "GROUP_ROWS", block)
    r = random.Random(7)
    make = lambda n: [(i, r.choice([None, *range(9)]), r.choice([None, 0.5, -0.0, 0.0, 1e300, -7.25, 3.0])) for i in range(n)]
    a, b = make(120), make(90)
    b += [(1000 + i, 4, 0.5) for i in range(60)]  # many equal rows
    da, db = (spark.createDataFrame(x, "id int, x int, y double") for x in (a, b))
    out = R.inequality_join(da, db, "x", "y", ["id"], ["id"])
    got = [(p.l_id, p.r_id) for p in out.collect()]
    want = {(p[0], q[0]) for p in a for q in b if None not in (*p[1:], *q[1:]) and p[1] < q[1] and p[2] > q[2]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    found = operators(out)
    assert not found["BroadcastNestedLoopJoin"] and not found["CartesianProduct"]
    assert R.inequality_join(da.limit(0), db, "x", "y", ["id"], ["id"]).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_counts_by_two_inequalities_against_pairs(spark, parts):
    r = random.Random(8)
    make = lambda n: [(i, r.choice([None, *range(9)]), r.choice([None, 0.5, -0.0, 0.0, 1e300, -7.25, 3.0])) for i in range(n)]
    a, b = make(120), make(90)
    b += [(1000 + i, 4, 0.5) for i in range(60)]  # many equal rows
    da, db = (spark.createDataFrame(x, "id int, x int, y double").repartition(parts) for x in (a, b))
    out = R.inequality_counts(da, db, "x", "y", "n")
    want = {p[0]: n for p in a if None not in p[1:] for n in [sum(None not in q[1:] and p[1] < q[1] and p[2] > q[2] for q in b)] if n}
    assert out.columns == ["id", "x", "y", "n"] and {p.id: p.n for p in out.collect()} == want and len(want) > 50
    assert R.inequality_counts(da.limit(0), db, "x", "y", "n").count() == 0 == R.inequality_counts(da, db.limit(0), "x", "y", "n").count()


def test_counts_need_no_pairs(spark):
    """20,000 rows with 200 million pairs, counted without making one."""
    d = spark.range(20_000).select("id", F.col("id").alias("x"), (-F.col("id")).alias("y"))
    out = R.inequality_counts(d, d, "x", "y", "n")
    assert out.agg(F.sum("n")).first()[0] == 20_000 * 19_999 // 2 and out.where("n <> 19999 - id").count() == 0


def test_overlaps_are_made_in_many_tasks(spark):
    d = spark.range(2000).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 10 * id) as s", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 10 * id, 50) as e").coalesce(1)
    tasks = R.overlap_join(d, d, [], "s", "e", ["id"], ["id"]).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in tasks) == 2000 and len(tasks) > 1


@pytest.mark.parametrize("key", [[], ["k"]])
@pytest.mark.parametrize("block, cell_rows", [(64, 100_000), (3, 100_000), (3, 10), (1, 7)])
def test_overlaps_in_blocks_and_parts_against_pairs(spark, monkeypatch, key, block, cell_rows):
    """Blocks that overlap in part, cells dealt into a grid of parts, equal rows, and a value that must be less."""
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    monkeypatch.setattr(R, "CELL_ROWS", cell_rows)
    r = random.Random(9)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(i, r.choice("ab"), r.choice([None, *range(12)]), at(s := r.randrange(900)), at(s + r.choice([0, 1, 20, 60, 61, 300, 10**6]))) for i in range(140)]
    rows += [(200 + i, "a", 5, at(30), at(45)) for i in range(20)]
    a, b = rows, rows[40:]
    da, db = (spark.createDataFrame(x, "id int, k string, u int, s timestamp_ntz, e timestamp_ntz").repartition(3) for x in (a, b))
    for less in (None, "u"):
        out = R.overlap_join(da, db, key, "s", "e", ["u", "id"], ["id", "u"], cell=60, less=less)
        assert out.columns == [*key, "l_u", "l_id", "r_id", "r_u"]
        got = [(x.l_id, x.r_id) for x in out.collect()]
        live = lambda p, q: p[3] < q[4] and q[3] < p[4] and p[3] < p[4] and q[3] < q[4] and (not key or p[1] == q[1])
        want = {(p[0], q[0]) for p in a for q in b if live(p, q) and (not less or None not in (p[2], q[2]) and p[2] < q[2])}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_overlaps_of_one_cell_fill_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL_ROWS", 100)
    d = spark.range(1000).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as s", "timestamp'2024-01-01 00:20:00' as e").coalesce(1)
    tasks = R.overlap_join(d, d, [], "s", "e", ["id"], ["id"]).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 1_000_000 and len(tasks) > 1


def test_written_overlaps_are_small(spark, tmp_path):
    """Pairs follow each other so that they pack: scattered ones take more than a byte each."""
    d = spark.range(3000).selectExpr("xxhash64(id) as id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, pmod(xxhash64(id, 1), 3600)) as s").selectExpr("*", "s + make_interval(0, 0, 0, 0, 0, 30) as e")
    out = R.overlap_join(d, d, [], "s", "e", ["id"], ["id"], less="id")
    out.write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs")).count()
    times = [x[0].timestamp() for x in d.select("s").collect()]
    assert pairs == sum(abs(x - y) < 1800 for x in times for y in times) // 2 - 1500
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.9 * pairs
