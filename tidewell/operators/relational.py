"""Joins over time, text containment, sums of hot keys, top-k by group, unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items (of ITEM_BYTES in all) that meet every document in one pass of a containment join.
ITEMS, ITEM_BYTES = 10_000, 32 << 20
#: Rows of the left side in one block of a group of an inequality join.
GROUP_ROWS = 10_000
#: Rows of one block, and of one side of one cell's group, of an overlap join.
BLOCK_ROWS, CELL_ROWS = 64, 100_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _cell(micros: Column, width: int) -> Column:
    """The cell of `width` microseconds, in whole numbers, that a time lies in."""
    return ((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("long")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, out: str, tie: str, cell: int = 86_400) -> DataFrame:
    """For each left row, the latest non-null right value of the same key strictly before it in (at, tie).

    Both sides are merged in time order and the last right value is carried on; no pair of rows
    is ever built. A key is cut into cells of `cell` seconds, so a hot one fills many tasks: rows are
    merged within their cell, and what a cell ends with goes to the key's later cells, one row a
    cell. Null keys match each other; left columns keep their names.
    """
    kind = right.schema[value].dataType
    l = left.withColumn("_v", F.lit(None).cast(kind)).withColumn("_left", F.lit(1))
    r = right.select(by, at, tie, F.col(value).alias("_v")).withColumn("_left", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_cell", _cell(_micros(F.col(at)), cell * 1_000_000))
    w = Window.partitionBy(by, "_cell").orderBy(at, tie, F.col("_left").desc()).rowsBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_left = 1")
    ends = both.groupBy(F.col(by).alias("_by"), F.col("_cell").alias("_c")).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(at, tie, "_v"))).alias("_end"))
    earlier = Window.partitionBy("_by").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_by", "_c", F.last("_end", ignorenulls=True).over(earlier)["_v"].alias("_before")).where("_before is not null")
    met = within.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_cell") == F.col("_c")), "left")
    return met.withColumn(out, F.coalesce("_in", "_before")).select(*left.columns, out)


def interval_join(left: DataFrame, right: DataFrame, key: list[str], at: str, width: float, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Pairs of equal keys whose times are within (0, width] seconds, to the microsecond, by time cells.

    The right side is dealt to its cell and the one before it, so each pair meets in one
    equi-join key and no key's rows meet all others.
    """
    span = round(width * 1_000_000)
    l = left.select(*key, *[F.col(c).alias(f"l_{c}") for c in left_cols], _micros(F.col(at)).alias("_lt")).withColumn("_cell", _cell(F.col("_lt"), span))
    r = right.select(*key, *[F.col(c).alias(f"r_{c}") for c in right_cols], _micros(F.col(at)).alias("_rt")).withColumn("_cell", _cell(F.col("_rt"), span))
    r = r.withColumn("_cell", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"))))
    return l.join(r, [*key, "_cell"]).where(f"_rt > _lt and _rt <= _lt + {span}").drop("_cell", "_lt", "_rt")


def _levels(a: DataFrame, b: DataFrame) -> list[int]:
    return sorted({r[0] for d in (a, b) for r in d.select("_home").distinct().collect()})  # at most 32 lengths


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], start: str, end: str, left_cols: list[str], right_cols: list[str], cell: int = 3600, less: str | None = None) -> DataFrame:
    """Pairs of equal keys whose intervals [start, end), in times, overlap: l_ and r_ columns, each pair once.

    An interval lies in the cells of a level that fits its length (a level's cells are four times those
    below, the lowest `cell` seconds), so in five at most; on every coarser level that is in use it has two at most.
    Two intervals meet on the coarser of their levels, in an equi-join by cell, and only the first cell
    that both lie in gives the pair. Rows with a null key, start or end, or an end not after the start, overlap nothing.
    `less` names one of left_cols and right_cols: then only pairs whose left value of it is below the right one (no nulls).

    Rows of a cell that are near in start and `less` are one block, and blocks meet as one row. Of two blocks each left row is
    followed by the same right rows, so runs and repeats follow each other and a written result takes a fraction of the
    bytes that scattered pairs take. A cell of more than CELL_ROWS rows a side is a grid of parts, each its own group.
    """
    base = cell * 1_000_000

    def laid(d: DataFrame, cols: list[str], mark: str) -> DataFrame:
        d = d.select(*key, *(F.col(c).alias(f"{mark}_{c}") for c in cols), _micros(F.col(start)).alias("_s"), _micros(F.col(end)).alias("_e")).where("_s < _e")
        if less:
            d = d.where(F.col(f"{mark}_{less}").isNotNull())
        # whole numbers decide the level; 31 levels of base cells hold any time
        long = F.col("_e") - F.col("_s")
        level = F.lit(30)
        for n in range(29, -1, -1):
            if base << 2 * n < 1 << 62:
                level = F.when(long <= F.lit(min(base << 2 * n + 2, (1 << 63) - 1)), n).otherwise(level)
        return d.withColumn("_home", level)

    a, b = laid(left, left_cols, "l"), laid(right, right_cols, "r")
    used = F.array(*(F.lit(n) for n in _levels(a, b) or [0]))
    width = F.when(F.col("_level") == 0, F.lit(base))
    for n in range(1, 31):
        width = width.when(F.col("_level") == n, F.lit(min(base << 2 * n, 1 << 62)))
    group = [*key, "_level", "_cell"]

    def dealt(d: DataFrame, mark: str) -> DataFrame:
        """A row a cell; whether it begins in the cell, and whether the level is its own."""
        d = d.withColumn("_level", F.explode(F.filter(used, lambda n: n >= F.col("_home")))).withColumn("_w", width)
        at = lambda c: ((c - F.pmod(c, F.col("_w"))) / F.col("_w")).cast("long")
        d = d.withColumn("_first", at(F.col("_s"))).withColumn("_cell", F.explode(F.sequence(F.col("_first"), at(F.col("_e") - 1))))
        begins, own = (F.col("_first") == F.col("_cell")).alias("_begins"), (F.col("_home") == F.col("_level")).alias("_own")
        return d.select(*group, *(c for c in d.columns if c.startswith(f"{mark}_")), "_s", "_e", begins, own)

    def blocks(d: DataFrame, mark: str) -> DataFrame:
        w = Window.partitionBy(*group)
        strips = []
        if less:  # as many strips by `less` as each then has blocks by time
            ranked = w.orderBy(f"{mark}_{less}")
            every = F.count("*").over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            d = d.withColumn("_n", every).withColumn("_strip", F.row_number().over(ranked) - 1)
            d = d.withColumn("_strip", F.floor(F.col("_strip") * F.ceil(F.sqrt(F.col("_n") / BLOCK_ROWS)) / F.col("_n"))).drop("_n")
            strips = ["_strip"]
        place = F.row_number().over(Window.partitionBy(*group, *strips).orderBy("_s")) - 1
        d = d.withColumn("_block", F.floor(place / BLOCK_ROWS))
        fields = [*(c for c in d.columns if c.startswith(f"{mark}_")), *(F.col(f"_{c}").alias(f"{mark}{c}") for c in ("s", "e", "begins", "own"))]
        d = d.groupBy(*group, *strips, "_block").agg(
            F.collect_list(F.struct(*fields)).alias(f"_{mark}"), F.min("_s").alias(f"_{mark}_from"), F.max("_e").alias(f"_{mark}_to"), F.bool_or("_begins").alias(f"_{mark}_begins"), F.bool_or("_own").alias(f"_{mark}_own"),
            *([F.min(f"{mark}_{less}").alias(f"_{mark}_least"), F.max(f"{mark}_{less}").alias(f"_{mark}_most")] if less else []),
        )
        return d.drop(*strips, "_block")

    from .ordered import kept

    a, b = dealt(a, "l"), dealt(b, "r")
    count = lambda d, name: d.groupBy(*group).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    large = kept(count(a, "_l_parts").join(count(b, "_r_parts"), group).where("_l_parts > 1 or _r_parts > 1"))
    if not large.isEmpty():  # a row for every CELL_ROWS rows at most
        def parted(d: DataFrame, own: str, other: str) -> DataFrame:
            d = d.join(F.broadcast(large), group, "left").withColumn("_at", F.pmod(F.xxhash64(*(c for c in d.columns if c not in group)), F.coalesce(own, F.lit(1))).cast("int"))
            d = d.withColumn("_with", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
            first, second = ("_at", "_with") if own == "_l_parts" else ("_with", "_at")
            return d.withColumns({"_l_part": F.col(first), "_r_part": F.col(second)}).drop("_at", "_with", "_l_parts", "_r_parts")

        a, b = parted(a, "_l_parts", "_r_parts"), parted(b, "_r_parts", "_l_parts")
        group = [*group, "_l_part", "_r_part"]
    # few bytes make many pairs, so the number of tasks must not follow the bytes
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = blocks(a.repartition(n, *group), "l").join(blocks(b.repartition(n, *group), "r"), group)
    met = met.where("_l_from < _r_to and _r_from < _l_to and (_l_begins or _r_begins) and (_l_own or _r_own)" + (" and _l_least < _r_most" if less else ""))
    # a filter on arrays is no part of the join's generated code, which would hold all pairs of a block at once
    met = met.withColumn("_r", F.filter("_r", lambda r: (r["rs"] < F.col("_l_to")) & (r["re"] > F.col("_l_from"))))
    met = met.select(*key, "_r", F.inline("_l"))
    met = met.select(*(c for c in met.columns if c != "_r"), F.inline("_r"))
    met = met.where("ls < re and rs < le and (lbegins or rbegins) and (lown or rown)" + (f" and l_{less} < r_{less}" if less else ""))
    return met.select(*key, *(f"l_{c}" for c in left_cols), *(f"r_{c}" for c in right_cols))


def inequality_join(left: DataFrame, right: DataFrame, x: str, y: str, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Pairs with left.x < right.x and left.y > right.y: l_ and r_ columns, each pair once.

    Both columns are replaced by the ranks of their values. Two ranks a < b part at one bit:
    above it they are equal, there a has 0 and b has 1. So each row is dealt, for every bit of
    its x rank that fits its side and every such bit of its y rank, to the group of rows equal above
    both; a pair meets in exactly one group and every row of the left meets every row of the right in it: an equi-join
    whose work is its output. Copies of a row are at most the bits of the ranks, multiplied; only
    groups that have rows of both sides are kept, before the rows travel. Rows with a null in x or y have no pair.
    """
    from .ordered import kept, running

    def ranked(column: str, mark: str) -> DataFrame:
        values = left.select(F.col(column).alias(mark)).union(right.select(F.col(column).alias(mark))).where(f"{mark} is not null").distinct()
        return running(values, [], [mark], {f"{mark}_rank": F.lit(1)})

    rx, ry = kept(ranked(x, "_x")), kept(ranked(y, "_y"))
    bits = lambda d: max(1, int(d.count()).bit_length())
    bx, by = bits(rx), bits(ry)

    def dealt(d: DataFrame, cols: list[str], mark: str, x_bit: int) -> DataFrame:
        d = d.select(*(F.col(c).alias(f"{mark}_{c}") for c in cols), F.col(x).alias("_x"), F.col(y).alias("_y"))
        d = d.join(rx, "_x").join(ry, "_y").drop("_x", "_y")
        for name, n, bit in (("_x", bx, x_bit), ("_y", by, 1 - x_bit)):
            rank = F.col(f"{name}_rank").cast("long")
            places = [F.when(F.getbit(rank, F.lit(i)) == bit, i) for i in range(n)]
            d = d.withColumn(f"{name}_at", F.explode(F.array_compact(F.array(*places))))
            d = d.withColumn(f"{name}_above", F.expr(f"shiftright(cast({name}_rank as bigint), {name}_at + 1)"))
        return d.drop("_x_rank", "_y_rank")

    group = ["_x_at", "_x_above", "_y_at", "_y_above"]
    a, b = dealt(left.withColumn("_row", F.monotonically_increasing_id()), [*left_cols, "_row"], "l", 0), dealt(right, right_cols, "r", 1)
    both = kept(a.groupBy(*group).agg(F.count("*").alias("_a")).join(b.groupBy(*group).agg(F.count("*").alias("_b")), group))
    # a group of many rows of both sides is dealt into blocks of the left
    both = both.withColumn("_blocks", F.ceil(F.col("_a") / GROUP_ROWS).cast("int")).drop("_a", "_b")
    a = a.join(both, group).withColumn("_block", F.pmod("l__row", F.col("_blocks")).cast("int")).drop("_blocks")
    b = b.join(both, group).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return a.join(b, [*group, "_block"]).select(*(f"l_{c}" for c in left_cols), *(f"r_{c}" for c in right_cols))


def inequality_counts(left: DataFrame, right: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """left, each row with the number of right rows with left.x < right.x and left.y > right.y; rows without any are left out.

    No pair is built. Equal points (x, y) are one, with their counts, and both columns are replaced by the ranks
    of their values. Two x ranks a < b part at one bit: above it they are equal, there a has 0 and b has 1. So each
    point goes, for every bit of its x rank, to the points equal above that bit, where a point with 0 counts the
    right rows with 1 before it in y: a running sum over ranges of the order, whatever one group's share of the
    points. Rows are as many as points times bits. Rows with a null in x or y have no pair.
    """
    from .ordered import kept, running

    def points(d: DataFrame, n: str, other: str) -> DataFrame:
        return d.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias(n)).withColumn(other, F.lit(0).cast("long"))

    every = points(left, "_l", "_r").unionByName(points(right, "_r", "_l")).groupBy("_x", "_y").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    every = kept(every)
    rank = lambda c: kept(running(every.select(c).distinct(), [], [c], {f"{c}_rank": F.lit(1)}))
    rx, ry = rank("_x"), rank("_y")
    ranked = kept(every.join(rx, "_x").join(ry, "_y").select("_x", "_y", "_l", "_r", F.col("_x_rank").cast("long").alias("_a"), F.col("_y_rank").cast("long").alias("_b")))
    bits = max(1, int(rx.count()).bit_length())
    dealt = ranked.select("_a", "_b", "_l", "_r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("_at"))
    dealt = dealt.withColumn("_bit", F.getbit("_a", "_at").cast("int")).withColumn("_above", F.expr("shiftright(_a, _at + 1)"))
    dealt = dealt.where("if(_bit = 0, _l, _r) > 0").select("_at", "_above", "_b", "_bit", F.when(F.col("_bit") == 0, F.col("_a")).alias("_a"), F.when(F.col("_bit") == 1, F.col("_r")).otherwise(0).alias("_n"))
    # of equal y those that count come first, and what is counted later
    met = running(dealt, ["_at", "_above"], ["_b", "_bit"], {"_before": F.col("_n")})
    found = met.where("_bit = 0 and _before > 0").groupBy("_a", "_b").agg(F.sum("_before").cast("long").alias(out))
    found = ranked.join(found, ["_a", "_b"]).select("_x", "_y", out)
    return left.join(found, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).drop("_x", "_y")


def not_in(left: DataFrame, right: DataFrame, key: Column, value: Column) -> DataFrame:
    """Rows of left whose key NOT IN the values of right holds, as SQL has it, without a broadcast of the values.

    An empty right side keeps every row, a null among its values none; else a null key is left out. The
    two counts that tell are one row; all other rows meet in an equi-join.
    """
    values = right.select(value.alias("_v"))
    facts = values.agg(F.count("*").alias("_all"), F.count_if(F.col("_v").isNull()).alias("_nulls"))
    rows = left.withColumn("_k", key).crossJoin(F.broadcast(facts)).where("_all = 0 or (_nulls = 0 and _k is not null)")
    return rows.join(values, F.col("_k") == F.col("_v"), "left_anti").select(*left.columns)


def containment_join(docs: DataFrame, items: DataFrame, doc_cols: list[str], item_cols: list[str], text: str = "text") -> DataFrame:
    """Pairs of a document and an item whose whole text, not empty, occurs in the document's.

    A theta join: items meet every document, but only as a broadcast of counted size; more items
    than that go in blocks, each a pass over the documents.
    """
    i = items.where(F.length(text) > 0).select(*item_cols, F.col(text).alias("_item"))
    n = i.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_item")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-n.n // ITEMS), -(-n.bytes // ITEM_BYTES))
    out = None
    for b in range(blocks):
        part = i if blocks == 1 else i.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b)
        met = docs.join(F.broadcast(part), F.contains(docs[text], part["_item"])).select(*doc_cols, *item_cols)
        out = met if out is None else out.union(met)
    return out


def salted_sum(df: DataFrame, key: str, value: Column, out: str, salts: int = 16) -> DataFrame:
    """Sum by key in two steps, hot keys spread over `salts` groups first, whatever the rows hold."""
    first = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(key, "_salt").agg(F.sum(value).alias("_part"))
    return first.groupBy(key).agg(F.sum("_part").alias(out))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)
