"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target is its weighted share of all words, at most `most` times its own words;
what is above goes to the others by weight until none is above. A document of a source with
target T and words S is wanted T / S times: the whole part is certain, the fraction is mass
to be rounded. Two documents of one source at a time transfer mass (words), in a random
direction whose chances keep each document's expectation, until one of them is taken or left
out; the other carries the remainder on. So the words taken stay the same at every step but
the last of a source: its one remainder goes up or down by its own chance, and the mass this
moves comes from, or goes to, the settled documents whose sizes are nearest to it.

The pairs form a tree. A source is dealt into groups of about GROUP documents, a hot source
into as many groups as it needs; each group is folded, largest documents first, to one
remainder; the remainders are grouped again, until each source has one. All randomness is
a hash of ids, the level and a seed, so reruns agree and any task can be run again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Workspace

GROUP = 256
#: Settled documents, one after the other, that balance a source's last remainder.
PARTNERS = 3
#: Equal rows that one step writes out again.
EXPAND = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Sources in code point order, null last, weigh 1, 2, ..., cycle and again. The capped
    shares are the water level of the classic filling problem: sorted by the level at which
    each reaches its cap, the sources up to some rank are capped and the rest share what is
    left by weight. The window runs over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double"))
    w = w.withColumn("_level", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = (
        w.withColumn("_capped", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_fill", (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_used")))
    )
    # the first source whose own cap lies at or above the level that is left ends the capping
    level = F.min(F.when(F.col("_fill") <= F.col("_level"), F.struct("_level", (-F.col("_fill")).alias("minus")))).over(every)["minus"]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(-level, F.lit(0.0)) * F.col("weight"))
    return w.withColumn("target", target).select("source", "source_size", "weight", "target")


def _chance(*key: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def _fold(rows: Column, level: int, seed: int) -> Column:
    """Fold an ordered array of (size, id, p) to the decided ones and one remainder.

    State: rest is the open document or null; done has (size, id, p) with p 0 or 1.
    """
    open_type = "struct<size:long,id:long,copy:long,rid:long,p:double>"
    start = F.named_struct(F.lit("rest"), F.lit(None).cast(open_type), F.lit("done"), F.array().cast(f"array<{open_type}>"))

    def settled(x: Column, p: Column) -> Column:
        return F.named_struct(F.lit("size"), x["size"], F.lit("id"), x["id"], F.lit("copy"), x["copy"], F.lit("rid"), x["rid"], F.lit("p"), p)

    def step(state: Column, b: Column) -> Column:
        a = state["rest"]
        ma, mb = a["p"] * a["size"], b["p"] * b["size"]
        to_b = F.least(ma, b["size"] - mb)  # as much as a can give and b can take
        to_a = F.least(mb, a["size"] - ma)
        give = _chance(F.lit(seed), F.lit(level), a["id"], a["copy"], b["id"], b["copy"]) * (to_a + to_b) < to_a
        # a gives: a is left out, or b is taken; else b gives: b is left out, or a is taken
        a_ends = F.when(give, ma <= b["size"] - mb).otherwise(a["size"] - ma < mb)
        pa = F.when(give, F.when(ma <= b["size"] - mb, F.lit(0.0)).otherwise((ma - to_b) / a["size"])).otherwise(F.when(a["size"] - ma < mb, F.lit(1.0)).otherwise((ma + to_a) / a["size"]))
        pb = F.when(give, F.when(ma <= b["size"] - mb, (mb + to_b) / b["size"]).otherwise(F.lit(1.0))).otherwise(F.when(a["size"] - ma < mb, (mb - to_a) / b["size"]).otherwise(F.lit(0.0)))
        ended = F.when(a_ends, settled(a, pa)).otherwise(settled(b, pb))
        rest = F.when(a_ends, settled(b, pb)).otherwise(settled(a, pa))
        both = F.named_struct(F.lit("rest"), rest, F.lit("done"), F.concat(state["done"], F.array(ended)))
        first = F.named_struct(F.lit("rest"), b, F.lit("done"), state["done"])
        return F.when(a.isNull(), first).otherwise(both)

    return F.aggregate(rows, start, step)


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: int = 3,
    group: int = GROUP,
    seed: int = 11,
) -> DataFrame:
    """Per document: id, source, size, source_size, target, copies, taken (copies * size).

    Defined cases: null and empty texts have size 0, no copies and nothing taken; a null
    source is a source of its own, in the last place; rows that repeat an id are told apart
    by a hash of source and text; of n equal rows wanted p times each the whole part of n p is taken and
    one row goes on with the remainder, however many they are; ids are whole numbers and may be null; a source without words has target 0; an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(spark, "mixing")
    each = docs.select(
        F.col(id_col).alias("doc"),
        F.col(source_col).alias("source"),
        words_in(F.col(text_col)).alias("size"),
        F.xxhash64(source_col, text_col).alias("copy"),
    )
    # equal rows are one from here on, counted in the tasks before they travel
    each = each.groupBy("doc", "source", "size", "copy").agg(F.count("*").alias("equal"))
    each = ws.put(each.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    stats = ws.put(each.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.count("*").alias("n")), "stats")
    targets = ws.put(source_targets(stats.select("source", "source_size"), most), "targets").join(stats.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "weight")
    targets = ws.put(targets, "shares").withColumnRenamed("source", "s2")
    rows = each.join(targets, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("ratio", F.least(ratio, F.lit(float(most)))).withColumn("sure", F.floor("ratio").cast("long"))
    rows = rows.withColumn("id", F.col("doc").cast("long")).withColumn("p", F.col("ratio") - F.col("sure"))
    # equal rows need no lot: as many as their whole mass are taken, and one carries what is left
    mass = F.col("p") * F.col("equal")
    rows = rows.withColumn("once", F.when(F.col("equal") > 1, F.floor(mass + 1e-9)).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("equal") > 1, F.greatest(mass - F.col("once"), F.lit(0.0))).otherwise(F.col("p")))
    rows = ws.put(rows, "rows")

    largest = stats.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(2, largest), group)) + 1)
    keys = ["source", "source_size", "target", "n", "sure"]
    member = F.struct("size", "id", "copy", "rid", "p")
    current = rows.where("size > 0 and p > 0").select(*keys, "size", "id", "copy", "rid", "p")
    decided = None
    for level in range(levels):
        cells = F.greatest(F.lit(1), F.ceil(F.col("n") / float(group) ** (level + 1)).cast("long"))
        dealt = current.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id", "copy"), cells))
        folded = dealt.groupBy(*keys, "cell").agg(F.sort_array(F.collect_list(member), asc=False).alias("rows"))
        folded = ws.put(folded.select(*keys, _fold(F.col("rows"), level, seed).alias("f")), f"level{level}")
        done = folded.select(*keys, F.explode("f.done").alias("d")).select(*keys, "d.*")
        decided = done if decided is None else decided.union(done)
        current = folded.where("f.rest is not null").select(*keys, "f.rest.*")
    # One remainder is left in each source.
    up = _chance(F.lit(seed), F.lit(-1), "id", "copy") < F.col("p")
    last = current.withColumn("up", up.cast("double")).withColumn("need", F.when(up, (1 - F.col("p")) * F.col("size")).otherwise(F.col("p") * F.col("size")))
    last = ws.put(last, "last")
    decided = ws.put(decided, "decided")
    asked = last.select(F.col("source").alias("s2"), F.col("up").alias("from"), "need")
    for i in range(PARTNERS):
        near = F.abs(F.col("size") - F.col("need"))
        partner = (
            decided.join(asked, F.col("source").eqNullSafe(F.col("s2")) & (F.col("p") == F.col("from")) & (near < F.col("need")))
            .groupBy("s2", "from", "need")
            .agg(F.min(F.struct(near.alias("near"), F.xxhash64("id", "copy").alias("h"), "rid", "size")).alias("best"))
        )
        partner = ws.put(partner, f"partner{i}")
        moved = partner.select(F.col("best.rid").alias("partner"))
        decided = decided.join(moved, F.col("rid") == F.col("partner"), "left").withColumn("p", F.when(F.col("partner").isNull(), F.col("p")).otherwise(1 - F.col("p"))).drop("partner")
        asked = partner.select("s2", F.when(F.col("best.size") <= F.col("need"), F.col("from")).otherwise(1 - F.col("from")).alias("from"), F.col("best.near").alias("need"))
    decided = decided.union(last.withColumn("p", F.col("up")).select(*decided.columns))
    lot = decided.where("p > 0.5").select(F.col("rid").alias("r2"), F.lit(1).alias("lot"))
    out = rows.join(lot, F.col("rid") == F.col("r2"), "left")
    # the rows that were equal again, some of them taken once more
    more = F.col("once") + F.coalesce("lot", F.lit(0))
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("equal") - 1) / EXPAND))))
    out = out.withColumn("i", F.explode(F.sequence(F.col("block") * EXPAND, F.least(F.col("block") * EXPAND + EXPAND, F.col("equal")) - 1)))
    copies = F.when(F.col("size") > 0, F.col("sure") + (F.col("i") < more).cast("long")).otherwise(F.lit(0)).cast("long")
    return out.withColumn("copies", copies).select(
        F.col("id").alias(id_col),
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, weights 1, 2, 3 by source."""
    from ..sources.tables import table

    return mix_sources(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
