"""Ranks, running sums and exact quantiles of partitions too large for one task.

Rows are dealt by ranges of the order, so each part holds a stretch of it; what earlier parts of a
key hold is one row a part, added up and carried on as an offset. Inside its part a row is counted
by a window. No task holds more than a part, whatever a key's share of the rows.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.formats import scratch

#: Values of a group that one task sorts; larger groups are narrowed first.
SORTED = 100_000
#: Narrowed ranges that are broadcast; more are joined by a shuffle.
RANGES = 100_000
#: Accuracy of a sketch, values taken from it, and the share of a range by which it may misplace them.
SKETCH, GRID, MARGIN = 10_000, 256, 0.0005


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each entry of sums, the sum over the rows of the same keys before it in `order`.

    order names columns, ascending, nulls first, that tell all rows of a key apart; rows equal in
    all of them are taken in any order. Null keys are keys. A sum before the first row is 0; nulls add nothing.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = {name: f"_own{i}" for i, name in enumerate(sums)}
    rows = df.select("*", *(F.coalesce(c, F.lit(0)).alias(own[name]) for name, c in sums.items()))
    rows = kept(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"{c}_all") for c in own.values()))
    before = lambda w: [F.coalesce(F.sum(f"{c}_all").over(w), F.lit(0)).alias(f"{c}_before") for c in own.values()]
    if keys:
        w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), *before(w))
    else:  # a row a part
        held = parts.orderBy("_part").collect()
        shape = parts.select(F.col("_part").alias("_p"), *(F.coalesce(f"{c}_all", F.lit(0)).alias(f"{c}_before") for c in own.values())).schema
        lines, total = [], [0] * len(own)
        for r in held:
            lines.append((r["_part"], *total))
            total = [t + (r[f"{c}_all"] or 0) for t, c in zip(total, own.values(), strict=True)]
        carried = F.broadcast(spark.createDataFrame([tuple({"double": float, "decimal": Decimal}.get(f.dataType.typeName(), int)(x) for x, f in zip(line, shape.fields, strict=True)) for line in lines], shape))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_p"))
    w = Window.partitionBy("_part", *keys).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    inside = [(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"{c}_before")).alias(name) for name, c in own.items()]
    return rows.join(carried, on).select(*df.columns, *inside)


def ranks(df: DataFrame, keys: list[str], order: list[str], tie: list[str], tiles: int = 4) -> DataFrame:
    """df with rn, rk, dr, tile, pr, cd: row_number, rank, dense_rank, ntile(tiles), percent_rank and cume_dist over (keys, order).

    tie: columns that order rows equal in `order`, for rn and tile alone. Ranks are worked out over the
    distinct values of the order with their counts, so equal values are no row of their own, and a value that
    many rows share spans parts without harm.
    """
    spots = [*keys, *order]
    values = df.groupBy(*spots).agg(F.count("*").alias("_n"))
    values = running(values, keys, order, {"_before": F.col("_n"), "_values": F.lit(1)})
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    named = lambda d, cols, mark: d.select(*(F.col(c).alias(f"{mark}{i}") for i, c in enumerate(cols)), *(c for c in d.columns if c not in cols))
    same = lambda cols, mark: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{mark}{i}")) for i, c in enumerate(cols)), F.lit(True))
    rows = running(df, keys, [*order, *tie], {"_rows": F.lit(1)})
    out = rows.join(named(values, spots, "_v"), same(spots, "_v"))
    out = out.join(named(total, keys, "_t"), same(keys, "_t")) if keys else out.withColumn("_all", F.lit(total.first()[0]))
    i, each, more = F.col("_rows"), F.floor(F.col("_all") / tiles), F.col("_all") % tiles
    tile = F.when(i < more * (each + 1), F.floor(i / (each + 1))).otherwise(more + F.floor((i - more * (each + 1)) / F.greatest(each, F.lit(1)))) + 1
    return out.select(
        *df.columns,
        (i + 1).cast("long").alias("rn"),
        (F.col("_before") + 1).cast("long").alias("rk"),
        (F.col("_values") + 1).cast("long").alias("dr"),
        tile.cast("long").alias("tile"),
        F.when(F.col("_all") > 1, F.col("_before") / (F.col("_all") - 1)).otherwise(0.0).alias("pr"),
        ((F.col("_before") + F.col("_n")) / F.col("_all")).alias("cd"),
    )


def exact_quantiles(df: DataFrame, key: str, value: str, shares: list[float], most: int = SORTED) -> DataFrame:
    """(key, share, quantile): continuous quantiles, exact, of groups of any size; nulls are left out, null keys are a group.

    A group of at most `most` values is sorted in one task. Of a larger one each wanted rank is
    narrowed: a sketch gives a range of values about it, a count of what lies below and inside
    proves where the rank is, and only that range is read again, until it is small or one value.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    sizes = kept(rows.groupBy("_k").agg(F.count("*").alias("_n")))
    big = sizes.where(F.col("_n") > most)
    asked = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("_s")
    place = F.col("_s") * (F.col("_n") - 1)
    wanted = big.select("_k", asked, "_n").select("_k", "_n", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_r")).distinct()
    # (key, rank): the rank lies among the _in values in [_lo, _hi], as the _i-th of them
    items = kept(wanted.select("_k", "_r", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.col("_r").alias("_i"), F.col("_n").alias("_in"))) if not big.isEmpty() else None
    found = []
    while items is not None and not items.isEmpty():
        items, ready = _narrowed(rows, items, most)
        found.append(ready)
    picked = reduce(DataFrame.unionByName, found) if found else None
    # small groups whole; of large ones the values at the wanted ranks
    low = _join_keys(rows, sizes.where(F.col("_n") <= most).select("_k"))
    small = low.groupBy("_k").agg(F.percentile("_v", [float(s) for s in shares]).alias("_q"))
    out = small.select("_k", F.posexplode("_q").alias("_at", "quantile")).select("_k", F.element_at(F.array(*(F.lit(float(s)) for s in shares)), F.col("_at") + 1).alias("share"), "quantile")
    if picked is not None:
        a, b = (picked.select(F.col("_k").alias(f"_k{x}"), F.col("_r").alias(f"_r{x}"), F.col("_v").alias(f"_v{x}")) for x in "ab")
        at = big.select("_k", asked, "_n").withColumn("_f", F.floor(place)).withColumn("_c", F.ceil(place)).withColumn("_w", place - F.floor(place))
        at = at.join(a, F.col("_k").eqNullSafe(F.col("_ka")) & (F.col("_f") == F.col("_ra"))).join(b, F.col("_k").eqNullSafe(F.col("_kb")) & (F.col("_c") == F.col("_rb")))
        out = out.unionByName(at.select("_k", F.col("_s").alias("share"), (F.col("_va") + (F.col("_vb") - F.col("_va")) * F.col("_w")).alias("quantile")))
    return out.withColumnRenamed("_k", key)


def _join_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.withColumnRenamed("_k", "_k2")
    return rows.join(k, F.col("_k").eqNullSafe(F.col("_k2")), "left_semi")


def _inside(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of each item's range, with the item."""
    few = items.count() <= RANGES
    i = items.withColumnRenamed("_k", "_k2")
    return rows.join(F.broadcast(i) if few else i, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop("_k2")


def _narrowed(rows: DataFrame, items: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(items that are still large, (key, rank, value) of the others), from one sketch and one count of the items' ranges."""
    own = ["_k", "_r", "_lo", "_hi", "_i", "_in"]
    inside = _inside(rows, items)
    share = (F.col("_i") + 0.5) / F.col("_in")
    sketch = inside.groupBy(*own).agg(F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], SKETCH).alias("_grid"))
    at = lambda i: F.get("_grid", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)).cast("int"))
    cut = kept(sketch.select(*own, at(F.floor((share - MARGIN) * GRID)).alias("_a"), at(F.ceil((share + MARGIN) * GRID)).alias("_b")))
    v, a, b, i = F.col("_v"), F.col("_a"), F.col("_b"), F.col("_i")
    between = (v > a) & (v < b)
    counted = _inside(rows, cut).groupBy(*own, "_a", "_b").agg(
        *(F.count_if(c).alias(n) for n, c in (("_lt_a", v < a), ("_le_a", v <= a), ("_lt_b", v < b), ("_le_b", v <= b))),
        *(f(F.when(c, v)).alias(n) for n, f, c in (("_under", F.max, v < a), ("_low", F.min, between), ("_high", F.max, between), ("_over", F.min, v > b))),
        F.min(v).alias("_least"), F.max(v).alias("_most"),
    )

    # the counts say on which side of the two values, or on which of them, the rank lies; both leave the range, so each round narrows it
    def chosen(under, at_a, inside, at_b, over):
        return F.when(i < F.col("_lt_a"), under).when(i < F.col("_le_a"), at_a).when(i < F.col("_lt_b"), inside).when(i < F.col("_le_b"), at_b).otherwise(over)

    now = kept(counted.select(
        "_k", "_r",
        chosen(F.col("_least"), a, F.col("_low"), b, F.col("_over")).alias("_lo"),
        chosen(F.col("_under"), a, F.col("_high"), b, F.col("_most")).alias("_hi"),
        chosen(i, i, i - F.col("_le_a"), i, i - F.col("_le_b")).alias("_i"),
        chosen(F.col("_lt_a"), F.lit(1), F.col("_lt_b") - F.col("_le_a"), F.lit(1), F.col("_in") - F.col("_le_b")).alias("_in"),
    ))
    one = now.where("_lo = _hi").select("_k", "_r", F.col("_lo").alias("_v"))
    few = now.where(f"_lo < _hi and _in <= {most}")
    read = _inside(rows, few).groupBy("_k", "_r", "_i").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    ready = one.unionByName(read.select("_k", "_r", F.expr("_all[cast(_i as int)]").alias("_v")))
    return now.where(f"_lo < _hi and _in > {most}"), kept(ready)
