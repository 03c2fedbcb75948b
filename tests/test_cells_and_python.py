"""Hot keys over time, bucketed tables, two-phase Python aggregates, the table-valued function."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.operators import cells as C
from tidewell.operators import python as P
from tidewell.plans.inspect import operators
from tidewell.sources.formats import bucketed, ordered_buckets, overwrite_partitions

SF = "/root/testdata/sf0.001"
BASE = datetime.datetime(1969, 12, 28)


def rows_of(seed, n=700, span=600_000):
    r = random.Random(seed)
    at = lambda: BASE + datetime.timedelta(seconds=r.choice([r.randrange(span), r.randrange(600), 86_400 * r.randrange(5)]), microseconds=r.choice([0, 1, 999_999]))
    return [(i, r.choice(["hot"] * 18 + ["b", None]), r.choice([at(), at(), at(), None] if r.random() < 0.1 else [at()]), r.randrange(9)) for i in range(n)]


@pytest.mark.parametrize("width", [60, 3600.5, 86_400])
def test_frames_of_a_hot_key(spark, width):
    rows = rows_of(1)
    d = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v int")
    got = {x.id: (x.n, x.s) for x in C.range_frame(d, "k", "ts", width, {"n": F.count("*"), "s": F.sum("v")}).collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        own = [x for x in rows if x[1] == k and (x[2] is None if t is None else x[2] is not None and t - datetime.timedelta(seconds=width) <= x[2] <= t)]
        assert got[i] == (len(own), sum(x[3] for x in own))


@pytest.mark.parametrize("cell", [300, 1800, 86_400, 10**9])
def test_sessions_of_a_hot_key(spark, cell):
    rows = rows_of(2)
    d = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v int")
    got = sorted(((x.k, x.session_start, x.session_last, x.n) for x in C.sessions(d, "k", "ts", 1800, cell).collect()), key=str)
    want = []
    by = defaultdict(list)
    for _, k, t, _ in rows:
        if t is not None:
            by[k].append(t)
    for k, times in by.items():
        times.sort()
        run = [times[0]]
        for t in times[1:]:
            if (t - run[-1]).total_seconds() < 1800:
                run.append(t)
            else:
                want.append((k, run[0], run[-1], len(run)))
                run = [t]
        want.append((k, run[0], run[-1], len(run)))
    assert got == sorted(want, key=str)
    assert C.sessions(d.limit(0), "k", "ts", 1800).count() == 0


def test_a_hot_users_rows_fill_many_tasks(spark):
    """Nine tenths of the rows on one user: the largest group is within four times the median."""
    d = spark.range(20_000).selectExpr("if(id % 10 = 0, id % 7, 99) as k", "timestamp_micros(cast(id as bigint) * 400000000) as ts")
    d = d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cell = C._cell(C._micros(F.col("ts")), 86_400_000_000)
    sizes = sorted(x.n for x in d.where("k = 99").groupBy("k", cell.alias("c")).agg(F.count("*").alias("n")).collect())
    assert sizes[-1] <= 4 * sizes[len(sizes) // 2]
    assert C.sessions(d, "k", "ts", 1800).agg(F.sum("n")).first()[0] == 20_000


# --- buckets ----------------------------------------------------------------------------------------


def test_bucketed_tables_join_as_they_lie(spark):
    a = bucketed(spark.range(3000).selectExpr("id as a", "id % 5 as x"), "tidewell_test_a", "a", 4)
    b = bucketed(spark.range(0, 3000, 2).selectExpr("id as b", "id % 7 as y"), "tidewell_test_b", "b", 4)
    with ordered_buckets(spark):
        joined = a.hint("merge").join(b, a["a"] == b["b"])
        found = operators(joined)
        assert joined.count() == 1500
    assert found["SortMergeJoin"] == 1 and not found["Exchange"] and not found["Sort"]
    assert not operators(a.hint("merge").join(b, a["a"] == b["b"]))["Exchange"]


def test_the_query_on_buckets_shuffles_only_its_counts(spark):
    found = operators(catalog.queries()["sink_bucketed_join"](spark, SF))
    assert found["SortMergeJoin"] == 1 and found["Exchange"] == 1


def test_only_partitions_at_hand_are_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    day = lambda *rows: spark.createDataFrame(list(rows), "v int, day string")
    overwrite_partitions(day((1, "a"), (2, "b"), (3, "b")), path, "day")
    out = overwrite_partitions(day((4, "b"), (5, "c")), path, "day")
    assert sorted((x.v, x.day) for x in out.collect()) == [(1, "a"), (4, "b"), (5, "c")]


# --- python -------------------------------------------------------------------------------------------


def test_states_are_merged_before_the_shuffle(spark, monkeypatch):
    """A state a key and task at most; hot keys, null keys and null values; states flushed early."""
    import pyarrow.compute as pc

    add = lambda s, v: str(int(s or 0) + (pc.sum(v).as_py() or 0)).encode()
    merge = lambda a, b: str(int(a) + int(b)).encode()
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["b", "c", None]), r.choice([None, 1, 2, 5])) for _ in range(3000)]
    d = spark.createDataFrame(rows, "k string, v long").repartition(6)
    want = defaultdict(int)
    for k, v in rows:
        want[k] += v or 0
    for held in (50_000, 1):
        monkeypatch.setattr(P, "HELD", held)
        out = P.two_phase(d, "k", "v", add, merge, lambda s: int(s), "total long")
        plan = operators(out)
        assert {x.k: x.total for x in out.collect()} == want
    assert P.two_phase(d.limit(0), "k", "v", add, merge, lambda s: int(s), "total long").count() == 0
    assert plan["MapInArrow"] == 1 and plan["Exchange"] <= 3


def test_sessions_function_partitions_by_itself(spark):
    P.register_sessions(spark)
    at = lambda m: BASE + datetime.timedelta(minutes=m)
    spark.createDataFrame([(1, at(40)), (1, at(0)), (1, at(10)), (2, at(5)), (None, at(1)), (2, None)], "key long, ts timestamp_ntz").createOrReplaceTempView("sessions_in")
    got = sorted((tuple(x) for x in spark.sql("SELECT key, session_start, n FROM tidewell_sessions(TABLE(sessions_in), 1800)").collect()), key=str)
    assert got == sorted([(1, at(0), 2), (1, at(40), 1), (2, at(5), 1), (None, at(1), 1)], key=str)
    with pytest.raises(Exception, match="key and ts"):
        spark.sql("SELECT * FROM tidewell_sessions(TABLE(SELECT 1 AS a), 60)").collect()
