"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

A window is `window` consecutive item words (a shorter item is one window). The
join goes by containment 1.0, so one token of each window is a necessary prefix:
the window's rarest shingle, rarity being counted over all documents. Documents
look up their shingles among those prefixes, positional and length bounds give
the only start a match can have, and the words there are compared one by one,
as 64-bit hashes.

The item side is taken in blocks of at most `block_windows` windows, so what a
task holds does not grow with the benchmark; each block meets all documents. What
blocks find is put together by a key that each row gets once and that is written down.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from ._shared import Workspace, ship, unused

BLOCK_WINDOWS = 200_000
_BITS = 20
_FOUND = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"


class Index:
    """One block of windows: their words' hashes, owners, and prefix shingles by rarity."""

    def __init__(self, windows: dict[tuple[int, ...], set[str]], shingle: int):
        self.shingle = shingle
        keys = sorted(windows)
        self.items = [sorted(windows[k]) for k in keys]
        self.lengths = np.array([len(k) for k in keys], dtype=np.int64)
        self.words = np.zeros((len(keys), int(self.lengths.max()) if keys else 0), dtype=K.U)
        for i, k in enumerate(keys):
            self.words[i, : len(k)] = k
        self.sizes = sorted({min(shingle, int(n)) for n in self.lengths})
        self.prefix: dict[int, tuple] = {}

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows whose shingles have this size, hashes [window, offset])."""
        at = np.flatnonzero(np.minimum(self.lengths, self.shingle) == size)
        w = self.words[at]
        n = w.shape[1] - size + 1
        h = np.zeros((len(at), n), dtype=K.U)
        for j in range(size):
            h *= K.U(K._WORD_BASE)
            h += w[:, j : j + n]
        h = K.mix(h)
        return at, h

    def order(self, counts: dict[int, int]) -> None:
        """Keep for each window its rarest shingle, ties by hash."""
        for size in self.sizes:
            at, h = self.grams(size)
            inside = np.arange(h.shape[1])[None, :] <= (self.lengths[at] - size)[:, None]
            each, inverse = np.unique(h, return_inverse=True)
            seen = np.array([counts.get(int(x), 0) for x in each.view(np.int64)], dtype=np.int64)
            rank = np.lexsort((each, seen))
            place = np.empty(len(each), dtype=np.int64)
            place[rank] = np.arange(len(each))
            p = np.where(inside, place[inverse.reshape(h.shape)], np.iinfo(np.int64).max)
            best = p.argmin(axis=1)
            key = h[np.arange(len(at)), best]
            o = np.argsort(key, kind="stable")
            self.prefix[size] = (key[o], at[o], best[o], _bitmap(key))


def _bitmap(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, dtype=bool)
    bits[(keys & K.U((1 << _BITS) - 1)).astype(np.int64)] = True
    return bits


def _blocks(items: DataFrame, window: int, shingle: int, most: int) -> Iterator[Index]:
    """Stream the items to the driver and cut blocks of `most` windows."""
    found: dict[tuple[int, ...], set[str]] = {}
    for row in items.select("item_id", "text").toLocalIterator():
        if row.item_id is None or not row.text:
            continue
        for _, _, w in K.words_of(pa.array([row.text]), K.NON_ALNUM, True):
            h = w.hash.tolist()
            for i in range(max(1, len(h) - window + 1) if h else 0):
                found.setdefault(tuple(h[i : i + window]), set()).add(str(row.item_id))
        if len(found) >= most:
            yield Index(found, shingle)
            found = {}
    if found:
        yield Index(found, shingle)


def _count(shared):
    """Occurrences of the block's shingles, over all documents of a task."""

    def run(batches):
        index: Index = shared.value
        total: dict[int, tuple] = {}
        for size in index.sizes:
            at, h = index.grams(size)
            inside = np.arange(h.shape[1])[None, :] <= (index.lengths[at] - size)[:, None]
            keys = np.unique(h[inside])
            total[size] = (keys, _bitmap(keys), np.zeros(len(keys), dtype=np.int64))
        for batch in batches:
            for _, _, w in K.words_of(batch.column(0), K.NON_ALNUM, True):
                for size, (keys, bits, n) in total.items():
                    _, h = w.windows(size)
                    h = h[bits[(h & K.U((1 << _BITS) - 1)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    n += np.bincount(at[keys[at] == h], minlength=len(keys))
        for keys, _, n in total.values():
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0].view(np.int64)), pa.array(n[n > 0])], ["gram", "n"])

    return K.lean(run)


def _match(index: Index, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word starts, windows) of all verified occurrences."""
    starts, windows = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    n = w.counts
    for size, (keys, owner, offset, bits) in index.prefix.items():
        at, h = w.windows(size)
        maybe = bits[(h & K.U((1 << _BITS) - 1)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        a, b = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
        m = b - a
        at, a, m = at[m > 0], a[m > 0], m[m > 0]
        which = np.repeat(a, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at, win = np.repeat(at, m), owner[which]
        doc = np.searchsorted(w.first, at, side="right") - 1
        begin, length = at - offset[which], index.lengths[win]
        ok = (length <= n[doc]) & (begin >= w.first[doc]) & (begin + length <= w.first[doc + 1])
        begin, win, length = begin[ok], win[ok], length[ok]
        for j in range(index.words.shape[1]):
            on = j < length
            same = ~on
            same[on] = w.hash[begin[on] + j] == index.words[win[on], j]
            begin, win, length = begin[same], win[same], length[same]
        starts.append(begin)
        windows.append(win)
    return np.concatenate(starts), np.concatenate(windows)


def _find(shared, carry: list[str]):
    """Merged hit spans and item ids of each document; its columns are those to carry and the text."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        index: Index | None = shared.value if shared else None
        for batch in batches:
            n_words, spans, items, sizes = [], [], [], []
            for a, b, w in K.words_of(batch.column(len(carry)), K.NON_ALNUM, True):
                n_words.append(w.counts)
                out_s: list[list] = [[] for _ in range(b - a)]
                out_i: list[set] = [set() for _ in range(b - a)]
                if index:
                    begin, win = _match(index, w)
                    o = np.argsort(begin, kind="stable")
                    begin, win = begin[o], win[o]
                    docs = np.searchsorted(w.first, begin, side="right") - 1
                    for d, s, x in zip(docs.tolist(), begin.tolist(), win.tolist(), strict=True):
                        s -= int(w.first[d])
                        e = s + int(index.lengths[x])
                        out_i[d].update(index.items[x])
                        if out_s[d] and s <= out_s[d][-1]["end"]:
                            out_s[d][-1]["end"] = max(e, out_s[d][-1]["end"])
                        else:
                            out_s[d].append({"start": s, "end": e})
                spans += out_s
                items += [sorted(x) for x in out_i]
            cols = [batch.column(i) for i in range(len(carry))]
            n = np.concatenate(n_words) if n_words else np.empty(0, dtype=np.int64)
            cols += [pa.array(n.astype(np.int64)), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [*carry, "n_words", "spans", "item_ids"])

    return K.lean(run)


def _merge(spans):
    """Union of spans that may overlap, as a SQL fold."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.named_struct(F.lit("start"), F.element_at(acc, -1)["start"], F.lit("end"), F.greatest(F.element_at(acc, -1)["end"], x["end"]))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def contamination(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    carry: list[str] | None = None,
    text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Documents with n_words, spans (word ranges that items cover, merged) and item_ids (sorted).

    carry: the columns of docs to return beside them (all but the text, unless named).
    items: item_id, text; other columns are ignored. Words are runs of
    `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lowered.

    Defined cases: a null or empty text has no words and no hit; null item texts
    or ids and items without words match nothing; equal items each count; repeated
    documents each get a row; no items or no documents give no hits or no rows;
    a text of any length is taken whole. A carried column may have any name but
    the three made here; one of those in docs is replaced.
    """
    ship(spark)
    made = {"n_words", "spans", "item_ids"}
    carry = [c for c in (carry if carry is not None else [c for c in docs.columns if c != text_col]) if c not in made]
    own, text = [F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), _FOUND])

    def ordered(index: Index, texts: DataFrame):
        """The block, its prefixes chosen by the shingles' counts over all documents, for the tasks."""
        first = spark.sparkContext.broadcast(index)
        rows = texts.mapInArrow(_count(first), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        first.destroy()
        index.order({r.gram: r.n for r in rows})  # at most the block's shingles
        return spark.sparkContext.broadcast(index)

    blocks = _blocks(items, window, shingle, block_windows)
    first, second = next(blocks, None), next(blocks, None)
    raw = unused(docs, "raw")
    slim = docs.select(*own, text.alias(raw))
    if second is None:
        return slim.mapInArrow(_find(ordered(first, docs.select(text)) if first else None, carry), schema)

    ws = Workspace(spark, "decontamination")
    row = unused(slim, "row")
    base = ws.put(slim.withColumn(row, F.monotonically_increasing_id()), "rows")
    hits = None
    for i, index in enumerate(chain((first, second), blocks)):
        shared = ordered(index, base.select(raw))
        found = base.select(row, raw).mapInArrow(_find(shared, [row]), f"`{row}` long, {_FOUND}")
        found = ws.put(found.where("size(spans) > 0").drop("n_words"), f"block{i}")
        shared.destroy()
        hits = found if hits is None else hits.union(found)
    hits = hits.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("item_ids")).alias("i"))
    hits = hits.select(row, _merge(F.col("s")).alias("spans"), F.array_sort(F.array_distinct("i")).alias("item_ids"))
    every = base.select(*own, row, raw).mapInArrow(_find(None, [*carry, row]), f"{schema.removesuffix(_FOUND)}`{row}` long, {_FOUND}").drop("spans", "item_ids")
    none = F.array()
    return every.join(hits, row, "left").select(
        *own, "n_words", F.coalesce("spans", none.cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("item_ids", none.cast("array<string>")).alias("item_ids")
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside item windows, and a digest of the items found."""
    from ..sources.tables import table

    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
