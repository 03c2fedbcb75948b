"""Connected components of an edge list, with the smallest node as the label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace

#: Edges that one task may take at once (16 bytes each); more go through star rounds.
ONE_TASK = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component), by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        if not (low < high).any():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _local(batches):
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if a and sum(map(len, a)):
        nodes, label = forest(np.concatenate(a), np.concatenate(b))
        moved = nodes != label
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(label[moved])], ["u", "v"])


def components(spark: SparkSession, ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge and is not its component's smallest.

    edges: two long columns, both ways allowed, repeats allowed, no nulls. Up to
    ONE_TASK edges are solved in one task; more alternate large-star and small-star
    rounds, each a min-aggregation and a join, until the edges stop changing.
    """
    edges = edges.toDF("u", "v")
    rounds = 0
    cur = ws.put(edges.where("u <> v").mapInArrow(_local, "u long, v long"), "forest0")
    before = None
    while True:
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state.n <= ONE_TASK:
            return cur.repartition(1).mapInArrow(_local, "u long, v long").toDF("node", "label")
        if before == (state.n, state.s):
            return cur.toDF("node", "label")
        before = (state.n, state.s)
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        rounds += 1
        cur = ws.put(small, f"forest{rounds}")
        ws.drop(f"forest{rounds - 1}")
