"""Python where no built-in says it: aggregates in two phases, and a table-valued function with a TABLE argument."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Keys whose states a task holds before it sends them on.
HELD = 50_000


def two_phase(df: DataFrame, key: str, value: str, add: Callable, merge: Callable, finish: Callable, result: str) -> DataFrame:
    """(key, result): an aggregate over Python states that are merged before and after the shuffle.

    add(state or None, values as an Arrow array) and merge(a, b) give states, which are bytes; finish(state)
    gives the result's value. Map tasks fold each batch into one state a key, so what is shuffled is at
    most a row for each key and task (more only beyond HELD keys a task). Reducers merge a few states at a time;
    a hot key's states meet in salted groups first. Null keys are a key.
    """
    kind = df.schema[key].dataType.simpleString()
    name, _, to = result.partition(" ")
    given = to_arrow_type(StructType.fromDDL(f"out {to}")["out"].dataType)

    def partial(batches):
        held: dict = {}

        def sent(of):
            return pa.RecordBatch.from_arrays([pa.array(list(held), of), pa.array(list(held.values()), pa.binary())], ["k", "state"])

        for batch in batches:
            k, v = batch.columns
            codes = k.dictionary_encode(null_encoding="encode")
            order = pc.sort_indices(codes.indices)
            codes_sorted, values = codes.indices.take(order).to_pylist(), v.take(order)
            at = 0
            for code, run in itertools.groupby(codes_sorted):
                n = sum(1 for _ in run)
                name_of = codes.dictionary[code].as_py()
                held[name_of] = add(held.get(name_of), values.slice(at, n))
                at += n
            if len(held) > HELD:
                yield sent(k.type)
                held.clear()
        if held:
            yield sent(k.type)

    def fold(states):
        out = None
        for s in states.to_pylist():
            out = s if out is None else merge(out, s)
        return out

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"k": table.column("k").slice(0, 1), "state": pa.array([fold(table.column("state"))], pa.binary())})

    def finished(table: pa.Table) -> pa.Table:
        return pa.table({"k": table.column("k").slice(0, 1), "out": pa.array([finish(fold(table.column("state")))], given)})

    states = df.select(F.col(key).alias("k"), F.col(value).alias("v")).mapInArrow(partial, f"k {kind}, state binary")
    some = states.withColumn("salt", F.pmod(F.xxhash64("state"), F.lit(16))).groupBy("k", "salt").applyInArrow(merged, f"k {kind}, state binary")
    done = some.groupBy("k").applyInArrow(finished, f"k {kind}, out {to}")
    return done.select(F.col("k").alias(key), F.col("out").alias(name))


def register_sessions(spark: SparkSession, name: str = "tidewell_sessions") -> None:
    """A table-valued function: sessions of the rows of TABLE(..., with columns key and ts), in parts by key and ordered by time.

    The function itself asks for the partitioning and the order (analyze), so a call needs only the TABLE
    argument and the gap in seconds. Rows stream through; of a key one open session is held.
    """
    from pyspark.sql.functions import AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
    from pyspark.sql.types import LongType, StructType, TimestampNTZType

    @udtf
    class Sessions:
        @staticmethod
        def analyze(rows, gap):
            if "key" not in rows.dataType.names or "ts" not in rows.dataType.names:
                raise ValueError("the table needs columns key and ts")
            shape = StructType().add("key", rows.dataType["key"].dataType).add("session_start", TimestampNTZType()).add("n", LongType())
            return AnalyzeResult(schema=shape, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("ts")])

        def __init__(self):
            self.now = None

        def eval(self, rows, gap):
            key, ts = rows["key"], rows["ts"]
            if ts is None:
                return
            if self.now and (ts - self.now[2]).total_seconds() < gap:
                self.now = (key, self.now[1], ts, self.now[3] + 1)
                return
            if self.now:
                yield self.now[0], self.now[1], self.now[3]
            self.now = (key, ts, ts, 1)

        def terminate(self):
            if self.now:
                yield self.now[0], self.now[1], self.now[3]

    spark.udtf.register(name, Sessions)
