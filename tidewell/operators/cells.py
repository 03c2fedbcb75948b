"""RANGE frames and sessions of keys that hold most of the rows, by cells of time.

A key's rows are cut into cells, so a hot key fills as many tasks as its time has cells. A frame
reaches at most one cell back, so each cell also gets the rows of the one before; sessions are made in
each cell, and only those at its borders are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import _cell, _micros


def range_frame(df: DataFrame, key: str, at: str, width: float, out: dict[str, Column]) -> DataFrame:
    """df with aggregates of the rows of its key in the time [at - width, at], in seconds; out: name to an aggregate such as F.sum("v").

    As a RANGE window of that width up to the current row, its peers included. Null keys are one key; rows
    with a null time see each other alone.
    """
    span = round(width * 1_000_000)
    d = df.withColumn("_at", _micros(F.col(at))).withColumn("_own", _cell(F.col("_at"), span))
    d = d.withColumn("_cell", F.explode(F.when(F.col("_own").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array("_own", F.col("_own") + 1))))
    w = Window.partitionBy(key, "_cell").orderBy("_at").rangeBetween(-span, 0)
    d = d.select(*df.columns, "_own", "_cell", *(c.over(w).alias(name) for name, c in out.items()))
    return d.where(F.col("_own").eqNullSafe(F.col("_cell"))).select(*df.columns, *out)


def sessions(df: DataFrame, key: str, at: str, gap: float, cell: float = 86_400) -> DataFrame:
    """(key, session_start, session_last, n): runs of a key's rows with less than `gap` seconds between neighbours.

    Sessions are made in cells of `cell` seconds. Of each cell only the first and last can go on
    beyond it; these, at most two a cell, are stitched in order of time. Null keys are one key; null times are left out.
    """
    wide, least = round(cell * 1_000_000), round(gap * 1_000_000)
    d = df.select(F.col(key).alias("_k"), _micros(F.col(at)).alias("_at")).where("_at is not null").withColumn("_cell", _cell(F.col("_at"), wide))

    def runs(rows: DataFrame, parts: list[str], start: str, last: str) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(start)
        new = F.when(F.lag(last).over(w) + least > F.col(start), 0).otherwise(1)
        return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    found = runs(d, ["_k", "_cell"], "_at", "_at").groupBy("_k", "_cell", "_run").agg(F.min("_at").alias("_start"), F.max("_at").alias("_last"), F.count("*").alias("n"))
    # a session that begins and ends more than a gap from its cell's borders is whole
    low = F.col("_cell") * wide
    border = (F.col("_start") - low < least) | (low + wide - F.col("_last") <= least)
    marked = found.withColumn("_border", border)
    open_ = runs(marked.where("_border"), ["_k"], "_start", "_last").groupBy("_k", "_run").agg(F.min("_start").alias("_start"), F.max("_last").alias("_last"), F.sum("n").alias("n"))
    whole = marked.where("not _border").select("_k", "_start", "_last", "n").unionByName(open_.select("_k", "_start", "_last", "n"))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return whole.select(F.col("_k").alias(key), time("_start").alias("session_start"), time("_last").alias("session_last"), F.col("n").cast("long").alias("n"))
