"""Phrases whose words occur together more often than apart.

First pass: each task counts the hashes of its n-grams (of 1 to `longest` words, with their
language) in a count-min sketch of two rows. What it sends are the filled cells of blocks of
65,536, and a shuffle by block merges the sketches: counts of a cell are added, so the
merged sketch is that of the whole corpus, and no cell is below the count of an n-gram in it.
All that is kept of it is one bit a cell: whether it reaches the least count. The number of
cells follows the corpus, four times its n-grams over the least count.

Second pass: an n-gram survives if its cell reaches the least count in both rows, and its own
parts survive. Survivors are counted exactly, by their words; others never leave the task.
An n-gram that is frequent has all its cells, and its parts', filled, so none is lost; those that only
collide are dropped by their exact counts.

Bits go to the tasks as a broadcast of at most SLICE cells a row. A larger sketch is cut by
n-gram hash into slices, each with both passes of its own, so memory stays bounded. Cells follow
the n-grams over the least count: with a least count that grows with the corpus one slice does. Inside a
task survivors are told apart by 64-bit hashes, between tasks by their words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from ._shared import Workspace, partitions, ship

U = np.uint64
#: Bytes that end a piece, and those between words of one.
ENDS = bytes([*b".,;:!?", *range(0x0A, 0x0E)])
GAPS = b"\x20\x09"
BLOCK_BITS = 16
#: Cells of a row in one slice at most: two rows of bits are 256 MB.
SLICE = 1 << 30
ROWS = 2
#: N-grams whose cells a task holds before it sends them.
HELD = 4 << 20
#: Steps' survivors that a task holds before it sends their sums.
SURVIVORS = 3 << 20
#: Partial ranks of a language, whatever its number of phrases.
SALTS = 32
_ROW_SEEDS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_STEP = U(0xC2B2AE3D27D4EB4F)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_IS_END = np.zeros(256, dtype=bool)
_IS_END[list(ENDS)] = True


class Grams:
    """N-grams of some documents: hashes[k - 1][i] is that of the k words from the i-th on, whole[k - 1][i] whether they lie in one piece."""

    def __init__(self, words: kernels.Words, langs: np.ndarray, longest: int):
        h, n = words.hash, len(words.hash)
        self.words, self.doc = words, np.repeat(np.arange(len(words.counts)), words.counts)
        ends = np.zeros(len(words.data) + 1, dtype=np.int32)
        np.cumsum(_IS_END[words.data], out=ends[1:])
        near = np.zeros(n, dtype=bool)  # whether the next word follows in the same piece
        if n:
            near[:-1] = (ends[words.starts[1:]] == ends[words.ends[:-1]]) & (self.doc[1:] == self.doc[:-1])
        lang = langs[self.doc]
        self.hashes, self.whole = [], []
        value, fits = np.zeros(n, dtype=U), np.ones(n, dtype=bool)
        for k in range(longest):
            if k:
                fits = fits.copy()
                fits[: max(0, n - k)] &= near[k - 1 : n - 1]
                fits[max(0, n - k) :] = False
            value = value * _STEP
            value[: n - k] += h[k:]
            self.hashes.append(kernels.mix(value + lang + U(k)))
            self.whole.append(fits)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (kernels.mix(h ^ U(_ROW_SEEDS[row])) >> U(64 - bits)).astype(np.int64)


def _of_slice(h: np.ndarray, slices: int, which: int) -> np.ndarray:
    return np.ones(len(h), dtype=bool) if slices == 1 else (h & U(slices - 1)) == U(which)


def _hashed(batch: pa.RecordBatch, longest: int):
    """Grams of document ranges of a batch (lang, text)."""
    name = batch.column(0)
    known = name.dictionary_encode()
    seeds = np.array([_seed(x) for x in known.dictionary.to_pylist()], dtype=U)
    langs = seeds[known.indices.to_numpy(zero_copy_only=False)] if len(name) else np.empty(0, dtype=U)
    data, offsets = kernels.strings(batch.column(1))
    for a, b in kernels.slices(offsets):
        words = kernels.Words(_FOLD[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], ENDS + GAPS, False)
        yield a, Grams(words, langs[a:b], longest)


def _seed(lang: str) -> int:
    x = 1469598103934665603
    for c in lang.encode():
        x = (x ^ c) * 1099511628211 & ((1 << 64) - 1)
    return x


def _count_type(least: int) -> str:
    return "<u1" if least < 1 << 8 else "<u4"


def _sketch(bits: int, longest: int, slices: int, which: int, least: int):
    """Batches of (lang, text) to filled cells: block (high bits and row), offsets as uint16, counts up to `least`, which is all that a sum needs to reach it."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, g in _hashed(batch, longest):
                h = np.concatenate([x[w] for x, w in zip(g.hashes, g.whole, strict=True)])
                h = h[_of_slice(h, slices, which)]
                held.append(h)
                n += len(h)
                if n >= HELD:
                    yield from sent(held)
                    held, n = [], 0
        if n:
            yield from sent(held)

    def sent(held):
        h = np.concatenate(held)
        for row in range(ROWS):
            cells, n = np.unique(_cells(h, row, bits).astype(np.uint32), return_counts=True)
            n = np.minimum(n, least).astype(_count_type(least))
            block = cells >> BLOCK_BITS
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(cells) else np.empty(0, dtype=np.int64)
            low = (cells & 0xFFFF).astype("<u2")
            for at in range(0, len(first), 1024):
                some = first[at : at + 1024]
                edge = np.append(some, first[at + 1024] if at + 1024 < len(first) else len(cells))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((block[some].astype(np.int64) << 1) + row, pa.int64()),
                        pa.array([low[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                        pa.array([n[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                    ],
                    ["block", "cells", "counts"],
                )

    return run


def _merge(least: int):
    """Sorted rows of blocks to (block, bits): a bit a cell, set where the counts add up to `least`. One block is held at a time."""

    def run(batches):
        now, total = None, None

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield closed()
                    now, total = block, np.zeros(1 << BLOCK_BITS, dtype=np.int64)
                total[np.frombuffer(cells, dtype="<u2")] += np.frombuffer(counts, dtype=_count_type(least))
        if now is not None:
            yield closed()

    return run


def _survivors(sketch, bits: int, longest: int, slices: int, which: int):
    """Batches of (lang, text) to exact counts of what survives: (lang, phrase, k, n); phrase '' has all words of a language."""

    def run(batches):
        rows = [np.frombuffer(x, dtype=np.uint8) for x in sketch.value]

        def filled(h: np.ndarray) -> np.ndarray:
            out = np.ones(len(h), dtype=bool)
            for r, packed in enumerate(rows):
                at = np.flatnonzero(out)
                c = _cells(h[at], r, bits)
                out[at] = (packed[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
            return out

        total: dict[str, int] = {}
        held = _Held()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, g in _hashed(batch, longest):
                for name, n in zip(langs[first:], g.words.counts.tolist(), strict=False):
                    total[name] = total.get(name, 0) + n
                alive = None
                for k, (h, whole) in enumerate(zip(g.hashes, g.whole, strict=True), 1):
                    ok = whole
                    if alive is not None and slices == 1:  # both parts of one word less
                        ok = ok & alive & np.append(alive[1:], False)
                    at = np.flatnonzero(ok & _of_slice(h, slices, which))
                    at = at[filled(h[at])]
                    alive = np.zeros(len(h), dtype=bool)
                    alive[at] = True
                    held.add(g, k, h, at, langs, first)
                if held.rows > SURVIVORS:
                    yield from held.give()
        yield from held.give()
        if which == 0:
            some = [(x, n) for x, n in total.items() if n]
            yield _rows([x for x, _ in some], pa.array([""] * len(some), pa.string()), [0] * len(some), [n for _, n in some])

    return run


class _Held:
    """Survivors of a task so far, by hash; the words of each are taken down once."""

    def __init__(self):
        self.known, self.rows = np.empty(0, dtype=U), 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # (hash, count) of each step
        self.texts: list[tuple[np.ndarray, list, pa.Array, int]] = []  # (hash, lang, phrase, k) of new ones

    def add(self, g: Grams, k: int, h: np.ndarray, at: np.ndarray, langs: list, first: int) -> None:
        x, where, n = np.unique(h[at], return_index=True, return_counts=True)
        if not len(x):
            return
        self.parts.append((x, n))
        self.rows += len(x)
        new = np.ones(len(x), dtype=bool)
        if len(self.known):
            i = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
            new = self.known[i] != x
        if new.any():
            some = at[where[new]]
            self.texts.append((x[new], [langs[first + d] for d in g.doc[some].tolist()], _phrases(g.words, some, k), k))
            self.known = np.sort(np.concatenate([self.known, x[new]]))

    def give(self):
        if self.rows:
            h, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            x, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, weights=n).astype(np.int64)
            for own, lang, phrase, k in self.texts:
                yield _rows(lang, phrase, np.full(len(own), k), n[np.searchsorted(x, own)])
        self.__init__()


def _rows(lang, phrase, k, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), phrase.cast(pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], ["lang", "phrase", "k", "n"])


def _phrases(words: kernels.Words, at: np.ndarray, k: int) -> pa.Array:
    """The texts of the k words from each place on, joined by one space."""
    w = (at[:, None] + np.arange(k)).ravel()
    size = words.ends[w] - words.starts[w]
    out = np.cumsum(size + 1)  # each word and a space behind it
    data = np.full(int(out[-1]) if len(out) else 0, 0x20, dtype=np.uint8)
    begin = out - size - 1
    step = np.repeat(words.starts[w] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    to = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    data[to] = words.data[step]
    # the last word's space is cut off by sliding each text over it
    edge = np.concatenate([[0], out[k - 1 :: k]])
    keep = np.ones(len(data), dtype=bool)
    keep[edge[1:] - 1] = False
    offsets = (edge - np.arange(len(edge))).astype(np.int32)
    return pa.Array.from_buffers(pa.utf8(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])


def phrase_counts(spark: SparkSession, docs: DataFrame, ws: Workspace, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, cells: int | None = None, most: int = SLICE) -> DataFrame:
    """(lang, phrase, k, n): exact counts of all phrases of 1 to `longest` words with n >= least; phrase '' (k 0) has all words.

    cells: of a sketch row over all slices, by default from the size of the texts. It changes how many phrases are counted
    in vain, never the result; so does `most`, the cells of a slice.
    """
    ship(spark)
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if cells is None:  # about six bytes a word
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = 4 * longest * size // 6 // least
    bits = max(BLOCK_BITS, (max(1, cells) - 1).bit_length())
    slices = max(1, (1 << bits) // most)
    bits -= slices.bit_length() - 1
    found = []
    for which in range(slices):
        sent = slim.mapInArrow(kernels.lean(_sketch(bits, longest, slices, which, least)), "block long, cells binary, counts binary")
        # of each block the rows lie together; one block is held at a time
        blocks = max(partitions(spark), ROWS << (bits - BLOCK_BITS) >> 6)
        merged = sent.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(kernels.lean(_merge(least)), "block long, bits binary")
        merged = ws.put(merged, f"sketch{which}")
        rows = [bytearray(1 << (bits - 3)) for _ in range(ROWS)]
        for block, part in merged.collect():  # at most SLICE bits a row
            at = (block >> 1) << (BLOCK_BITS - 3)
            rows[block & 1][at : at + len(part)] = part
        held = spark.sparkContext.broadcast([bytes(r) for r in rows])
        each = slim.mapInArrow(kernels.lean(_survivors(held, bits, longest, slices, which)), "lang string, phrase string, k int, n long")
        exact = each.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0))
        found.append(ws.put(exact, f"counts{which}"))
        held.destroy()
        ws.drop(f"sketch{which}")
    return reduce(DataFrame.unionByName, found)


def collocations(
    spark: SparkSession, docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
    least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, cells: int | None = None, most: int = SLICE,
) -> DataFrame:
    """Per language, the first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a = f(phrase); cut behind its first k words it has l and r = f of the parts and the
    score floor(10^6 a a / (l r)); the cut of lowest score counts, the first of equal ones. A phrase
    inside a longer one that is at least `share` per cent as frequent is dropped. Products are 38-digit
    decimals and divisions whole, exact for counts below 10^15.

    Defined cases: null and empty texts have no words; a null language is `und`; repeated rows count
    again; phrases of equal score and count go by their UTF-8 bytes; an empty table, or one without frequent
    phrases, gives no rows; other columns, also those named like the result's, are not read.
    """
    ws = Workspace(spark, "collocations")
    f = phrase_counts(spark, docs, ws, lang_col, text_col, least, longest, cells, most)
    words = f.where("k = 0").select("lang", F.col("n"))
    part = f.where(f"k between 1 and {longest - 1}").select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    phrases = f.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    side = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cut = cut.select("lang", "phrase", "k", "a", "cut", side(F.lit(1), F.col("cut")).alias("left"), side(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    # many phrases share a first or last word: plain joins, so that a hot one can be split at run time
    for which, name in (("left", "l"), ("right", "r")):
        cut = cut.join(part.select(F.col("lang"), F.col("part").alias(which), F.col("m").alias(name)), ["lang", which])
    big = lambda c: F.col(c).cast("decimal(16,0)")
    cut = cut.withColumn("aa", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("lr", big("l") * big("r"))
    cut = cut.withColumn("score", F.expr("aa div lr"))
    scored = cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    scored = ws.put(scored.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score"), "scored")
    inner = scored.where("k > 2").withColumn("w", F.split("phrase", " ")).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("outer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < share * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each part of a language, then of the language: at most SALTS * top rows for one task
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of whole documents, by language."""
    from ..sources.tables import table

    return collocations(spark, table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
u AS (SELECT lang, phrase, k, a, w, cut, array_to_string(w[1 : cut], ' ') AS lp, array_to_string(w[cut + 1 : k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (
  SELECT u.lang, u.phrase, u.k, u.a, x.a AS l, y.a AS r, cast((1000000::HUGEINT * u.a * u.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score, cut
  FROM u JOIN f x ON x.lang = u.lang AND x.phrase = lp JOIN f y ON y.lang = u.lang AND y.phrase = rp
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, sub, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS sub FROM c WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.sub = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM z)
SELECT q.lang, rank, phrase, a, l, r, t.n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""
