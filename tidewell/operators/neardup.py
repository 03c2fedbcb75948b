"""Near-duplicate texts by MinHash signatures and banded buckets, verified.

A text is its set of distinct runs of five words. Its signature holds the least value of each of
128 hash functions over the set; 32 bands of four values each put it into buckets. Two sets of
similarity s share a bucket with a chance of 1 - (1 - s^4)^32, at 0.75 all but 5 in a million. Equal sets are one
class before that, so copies never meet in pairs.

Buckets are not expanded into pairs. In each of a few rounds every bucket with members of more than
one component names a hub, and only members of other components are compared with it, by
their whole sets. A group of near copies is so joined by a few comparisons a member. Buckets that
still hold several components are compared in blocks, inside tasks, which emit only links.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.formats import bucketed
from .ordered import kept

HASHES, BANDS = 128, 32
#: Rounds of hubs before buckets are compared in blocks, and members of a block.
STARS, BLOCK = 3, 128
#: How far an estimate may fall short of the wanted similarity and still be verified: four standard errors at 0.75.
SLACK = 0.15
#: Rows sharing a bucket that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_U = np.uint64
_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingles(text: str, words: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words; the whole text where it has fewer, nothing where it has none."""
    w = _WORD.findall(text.translate(_FOLD))
    if not w:
        return np.empty(0, dtype=_U)
    for x in w:
        if x not in known:
            if len(known) > 500_000:
                known.clear()
            known[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    try:
        h = np.array([known[x] for x in w], dtype=_U)
    except KeyError:  # a text of more distinct words than are held
        h = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in w], dtype=_U)
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, dtype=_U)
    for j in range(k):
        out = out * _U(0xD1342543DE82EF95) + h[j : len(h) - k + 1 + j]
    out = np.sort(_mix(out + _U(k)))
    return out[np.append(True, out[1:] != out[:-1])]


def signature(s: np.ndarray) -> np.ndarray:
    """Least value of each hash over a set that is not empty."""
    out = np.full(HASHES, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(s), 1024):
        out = np.minimum(out, ((s[at : at + 1024, None] * _A + _B) >> _U(32)).min(0).astype(np.uint32))
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, -1).astype(_U)
    out = np.arange(1, BANDS + 1, dtype=_U)
    for j in range(rows.shape[1]):
        out = _mix(out + rows[:, j])
    return out.view(np.int64)


def _marks(docs: DataFrame, words: int) -> DataFrame:
    """(row, n, digest, bands) of (row, text): what all rows are compared by before any set travels."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            n, digest, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text or "", words, known)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(_bands(signature(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["row", "n", "digest", "bands"])

    return docs.mapInArrow(run, "row long, n long, digest binary, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(row, n, sig, set) of (row, text)."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            sets = [shingles(text or "", words, known) for text in batch.column(1).to_pylist()]
            sig, held = (pa.array(x, pa.binary()) for x in ([signature(s).astype("<u4").tobytes() for s in sets], [s.astype("<u8").tobytes() for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), sig, held], ["row", "n", "sig", "set"])

    return docs.mapInArrow(run, "row long, n long, sig binary, set binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): the least node of each component, by neighbours' roots and jumps."""
    both = kept(edges.union(edges.select("b", "a")).distinct())
    now = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy(F.col("a").alias("n2")).agg(F.min("root").alias("near"))
        jump = now.select(F.col("node").alias("n3"), F.col("root").alias("far"))
        step = now.join(near, now["node"] == near["n2"]).join(jump, F.col("root") == F.col("n3"))
        step = kept(step.select("node", F.least("root", "near", "far").alias("root"), (F.least("near", "far") < F.col("root")).alias("moved")))
        now = step.select("node", "root")
        if step.where("moved").isEmpty():
            return now


def _linked(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar."""

    def run(batches):
        for batch in batches:
            ok = [_linked(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # sizes first, as they are short; then only a's sets travel, and only those of pairs: the table of sets lies in buckets by row
    side = lambda m, c: sets.select(F.col("row").alias(m), F.col(c).alias(f"{c}{m}"))
    sized = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    met = kept(pairs.join(side("a", "n"), "a").join(side("b", "n"), "b").where(sized).select("a", "b"))
    met = met.join(side("a", "set"), "a").join(side("b", "set"), "b")
    return met.select("a", "b", "seta", "setb").mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members (key, row, comp) of one key and different components, block by block."""
    size = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = members.join(size, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).join(sets.select("row", "n", "sig", "set"), "row")
    own = ["key", "i", "j", "row", "comp", "n", "sig", "set"]
    left = m.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select(*own)
    right = m.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block")))).select(*(F.col(c).alias(c) for c in own))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        if a.num_rows and b.num_rows:
            sa, sb = (np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u4").reshape(-1, HASHES) for t in (a, b))
            na, nb = a.column("n").to_numpy(), b.column("n").to_numpy()
            ra, rb, ca, cb = (x.to_pylist() for x in (a.column("row"), b.column("row"), a.column("comp"), b.column("comp")))
            sets_a, sets_b = a.column("set").to_pylist(), b.column("set").to_pylist()
            for i in range(len(ra)):
                like = (sb == sa[i]).mean(1) >= similarity - SLACK
                like &= np.minimum(na[i], nb) >= similarity * np.maximum(na[i], nb) - 1e-9
                for j in np.flatnonzero(like).tolist():
                    if top(ca[i]) != top(cb[j]) and _linked(np.frombuffer(sets_a[i], dtype="<u8"), np.frombuffer(sets_b[j], dtype="<u8"), similarity):
                        root[top(ca[i])] = top(cb[j])
                        found.append((ra[i], rb[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    keys = ["key", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.75) -> DataFrame:
    """Per document: id, n_shingles, class_id (smallest id of equal sets), component_id (smallest id reachable by links).

    A-Z count as a-z; words stand between ASCII white space. Null and empty texts have no set, a class
    of their own and no link; rows that share an id are judged each by itself; a null id counts as larger than any
    other; other columns are not read; an empty table gives no rows. similarity is 0.5 or more.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must lie in [0.5, 1]")
    ship(docs.sparkSession)
    named = kept(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")))
    marks = kept(_marks(named.select("row", "text"), words))
    rows = marks.select("row", "n", "digest").join(named.select("row", "id"), "row")
    first = lambda: F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = kept(rows.where("n > 0").groupBy("digest").agg(first().alias("first")))
    classes = classes.select("digest", F.col("first.row").alias("rep"), F.col("first.id").alias("class_id"))
    reps = classes.select(F.col("rep").alias("row"))
    dealt = kept(marks.join(reps, "row").select("row", F.explode("bands").alias("key")))
    # buckets of the same members are one: told by their number and 128 bits over them
    alike = ["c", *(f"h{i}" for i in range(2))]
    full = dealt.groupBy("key").agg(F.count("*").alias("c"), *(F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"h{i}") for i in range(2))).where("c > 1")
    full = full.groupBy(*alike).agg(F.min("key").alias("key")).select("key")
    buckets = kept(dealt.join(full, "key"))
    # only texts that share a bucket have their sets written down
    meeting = kept(buckets.select("row").distinct())
    few = meeting.count() <= BROADCAST_ROWS
    sets = _sets(named.join(F.broadcast(meeting) if few else meeting, "row", "left_semi").select("row", "text"), words)
    spark = docs.sparkSession
    sets = bucketed(sets, f"tidewell_sets_{uuid.uuid4().hex}", "row", int(spark.conf.get("spark.sql.shuffle.partitions")))
    labels = kept(reps.select("row", F.col("row").alias("comp")))
    for turn in range(STARS + 1):
        now = kept(buckets.join(labels, "row"))
        hub = F.min(F.struct(F.col("row") if turn == 0 else F.xxhash64("row", F.lit(turn)), F.col("row").alias("hub"), F.col("comp").alias("of"))).alias("h")
        open_ = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), hub).where("low < high").select("key", "h.hub", "h.of")
        if turn < STARS:
            pairs = now.join(open_, "key").where("comp <> of").select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")).distinct()
            links = kept(_verified(pairs, sets, similarity))
        else:
            links = kept(_in_blocks(now.join(open_.select("key"), "key"), sets, similarity))
        if not links.isEmpty():
            labels = _merged(labels, links)
    by_class = classes.join(labels, classes["rep"] == labels["row"]).select("digest", "class_id", "comp")
    smallest = by_class.groupBy("comp").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id")).alias("s")).select("comp", F.col("s.class_id").alias("component_id"))
    known = by_class.join(smallest, "comp").select("digest", "class_id", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    out = rows.where("n > 0").join(known, "digest").select("id", "n", "class_id", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links' components are joined."""
    of = lambda m: labels.select(F.col("row").alias(m), F.col("comp").alias(f"comp_{m}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()
    roots = connected(edges)
    return kept(labels.join(roots, labels["comp"] == roots["node"], "left").select("row", F.coalesce("root", "comp").alias("comp")))
