"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into tokens: words, single characters of scripts without spaces, and before and
after these the ENDS first and last characters one by one, between K - 1 marks of the start and as many
of the end. So a text of one word has anchors too, and texts of any length go one way. A k-mer is K
tokens in a row; it is a closed syncmer when the least of its tokens by hash is its first or
its last. Whether a k-mer is chosen depends on its own tokens alone, so equal passages give
equal anchors whatever stands around them; a mark is less than any token, so each text is
anchored at its ends.

Each anchor is a hash and its position, in one long. A fingerprint holds the anchors of least
hash, a uniform sample of the whole text: FLOOR of them and one in DENSITY of all, or all
(density 1). The sample grows with the text, so what is seen of a passage does not shrink.

Two fingerprints are matched by position: anchors of equal hash whose distance agrees with
the median distance, over all anchors below the hash where the thinner sample ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace, partitions, unused

K, ENDS, FLOOR, DENSITY, SLACK = 4, 16, 48, 16, 64
# Scripts written without spaces, each of whose characters is a token.
_UNSPACED = r"\x{0E00}-\x{0E7F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}"
_HIGH = -(1 << 32)
_SIDE = 1 << 31
_NULL_KEY = -(1 << 63)
_START, _END = -(1 << 63), -(1 << 63) + 1


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name standing for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _all_anchors(text: str) -> str:
    """SQL of all anchors of SQL text, unsorted: hash in the upper 32 bits, position in the lower 31."""
    mark = lambda v: f"array_repeat(cast({v} as bigint), {K - 1})"
    # splitting at white space is several times cheaper than matching words; few texts have characters to set apart
    spaced = f"if({text} rlike r'[{_UNSPACED}]', regexp_replace({text}, r'([{_UNSPACED}])', ' $1 '), {text})"
    tokens = rf"concat(split(left({text}, {ENDS}), ''), split({spaced}, r'\s+'), split(right({text}, {ENDS}), ''))"
    h = f"concat({mark(_START)}, transform(filter({tokens}, t -> t <> ''), t -> xxhash64(t)), {mark(_END)})"
    inner = ", ".join(f"h[i + {j}]" for j in range(1, K - 1))
    chosen = f"filter(sequence(0, size(h) - {K}), i -> least(h[i], h[i + {K - 1}]) <= least({inner}))"
    kmer = ", ".join(f"h[i + {j}]" for j in range(K)).replace("h[i + 0]", "h[i]")
    return _let("h", h, f"transform({chosen}, i -> (xxhash64({kmer}) & {_HIGH}L) | i)")


def fingerprint(text: str, density: int = DENSITY) -> str:
    """SQL of the fingerprint of SQL text: sorted anchors, the first of each hash.

    The last value tells where the sample ends: the least hash left out, or the largest possible.
    """
    first = "filter(a, (x, i) -> i = 0 or shiftright(x, 32) <> shiftright(a[i - 1], 32))"
    most = "size(u)" if density == 1 else f"least(size(u), {FLOOR} + cast(size(u) / {density} as int))"
    cut = f"concat(slice(u, 1, {most}), array(coalesce(get(u, {most}) & {_HIGH}L, {(1 << 63) - 1}L)))"
    return _let("a", f"sort_array({_all_anchors(text)})", _let("u", first, cut))


def written(fp: str) -> str:
    """SQL of a fingerprint as a string of hex numbers."""
    return f"array_join(transform({fp}, x -> lower(hex(x))), '.')"


def likeness(a: str, b: str) -> str:
    """SQL of how alike two fingerprints are, 0 to 1: anchors that match in place, of all anchors of the two."""
    upto = lambda x: f"filter({x}, v -> v < e)"
    both = f"sort_array(concat({upto(a)}, transform({upto(b)}, v -> v | {_SIDE}L)))"
    place = f"{_SIDE - 1}L"
    apart = f"sort_array(transform(filter(sequence(1, size(c) - 1), i -> shiftright(c[i], 32) = shiftright(c[i - 1], 32)), i -> (c[i] & {place}) - (c[i - 1] & {place})))"
    held = f"size(filter(d, v -> abs(v - d[cast(size(d) / 2 as int)]) <= {SLACK}))"
    ratio = _let("d", apart, _let("m", held, "m / cast(size(c) - m as double)"))
    return _let("e", f"least(element_at({a}, -1), element_at({b}, -1))", _let("c", both, f"if(size(c) < 2, 0D, {ratio})"))


def fingerprints(docs: DataFrame, text_col: str = "text", density: int = DENSITY) -> DataFrame:
    """All columns of docs with fingerprint, a string. density 1 keeps every anchor.

    Defined cases: null and empty texts have the anchors of the marks; equal texts have
    equal fingerprints; texts of any length are read whole; a column of that name is replaced,
    others may have any name.
    """
    keep = [c for c in docs.columns if c != "fingerprint"]
    fp = unused(docs, "fp")
    d = docs.selectExpr(*(f"`{c}`" for c in keep), f"{fingerprint(f"coalesce(`{text_col}`, '')", density)} as {fp}")
    return d.selectExpr(*(f"`{c}`" for c in keep), f"{written(fp)} as fingerprint")


def next_ids(spark: SparkSession, ws: Workspace, ids: DataFrame) -> DataFrame:
    """(key) distinct -> (key, next_key): the next smaller key, after the smallest the largest.

    Keys are dealt into ranges; only each range's ends, one row a range, meet in one place.
    """
    from pyspark.sql import Window

    ranged = ids.repartitionByRange(partitions(spark), F.col("key").desc()).select("*", F.spark_partition_id().alias("part"))
    ranged = ws.put(ranged, "ranged")
    ends = ranged.groupBy("part").agg(F.max("key").alias("top"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("top").over(order), F.first("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inner = F.lead("key").over(Window.partitionBy("part").orderBy(F.col("key").desc()))
    with_next = ranged.withColumn("inner", inner)
    return with_next.join(F.broadcast(ends), "part").select(*ids.columns, F.coalesce("inner", "after").alias("next_key"))  # ends: a row a partition


def edited_likeness(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document (descending id).

    The edited text is the document's, its last third (in code points, rounded down) replaced
    by as many first code points of the next document's, or all it has. Returns id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Only what is needed moves: documents by id once, and a third of each to its neighbour.
    Defined cases: null texts are empty; a null id is the last in order; of rows that repeat an
    id the least text is the neighbour's, and each row is answered; one document is its own neighbour;
    an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(spark, "fingerprints")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Each text's own fingerprint is worked out once and written down; its neighbour reads it from there.
    made = ws.put(base.select("key", F.char_length("text").alias("n"), F.xxhash64("text").alias("copy"), F.expr(fingerprint("text")).alias("fp")), "made")
    sizes = ws.put(made.groupBy("key").agg(F.max(F.floor(F.col("n") / 3)).cast("int").alias("want"), F.count("*").alias("rows")), "sizes")
    ask = ws.put(next_ids(spark, ws, sizes.select("key", "want")), "ask").select(F.col("key").alias("asker"), F.col("next_key").alias("key"), "want")
    repeated = bool(sizes.where("rows > 1").limit(1).count())
    if repeated:
        fp = base.withColumn("copy", F.xxhash64("text")).join(made.dropDuplicates(["key", "copy"]).drop("n"), ["key", "copy"]).drop("copy")
    else:
        fp = base.join(made.select("key", "fp"), "key")
    given = ask.join(fp, "key").select("asker", F.struct(F.substring("text", F.lit(1), F.col("want")).alias("head"), F.col("fp").alias("fp")).alias("next"))
    if repeated:
        given = given.groupBy("asker").agg(F.min("next").alias("next"))
    d = fp.join(given.withColumnRenamed("asker", "key"), "key")
    d = d.withColumn("n", F.char_length("text")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("cut")), F.substring("next.head", F.lit(1), F.col("cut"))))
    d = d.select("key", "n", F.sha2("edited", 256).alias("edited_sha256"), "fp", F.expr(fingerprint("edited")).alias("efp"), F.col("next.fp").alias("nfp"))
    return d.select(
        F.when(F.col("key") != _NULL_KEY, F.col("key")).alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        F.expr(written("fp")).alias("fingerprint"),
        F.expr(written("efp")).alias("edited_fingerprint"),
        F.expr(likeness("fp", "efp")).alias("near_edited"),
        F.expr(likeness("fp", "nfp")).alias("near_next"),
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents, by closed syncmers of four words."""
    from ..sources.tables import table

    return edited_likeness(spark, table(spark, sf_dir, "documents"))
