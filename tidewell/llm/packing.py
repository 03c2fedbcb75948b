"""Packing of documents into sequences of a fixed length, every one in the mixture's proportions.

Sources are queues of tokens. Each window gives every queue a quantum, its target share of the
window; a queue hands out the whole tokens of its quantum and of the deficit that earlier
windows left it, and keeps the fraction as its deficit. Documents are cut where a queue's turn ends
and go on in the next window.

While the queues last, shares do not change, so the tokens that queue j has handed out before
window w are known without replaying the windows: with A(j) the tokens that queues 0..j
give in n windows, floor(w A(j) / n) - floor(w A(j-1) / n), never a token from its target. Deficits are so carried
across windows, and into every partition: a task knows where each of its documents lies in
its queue, and cuts it by this rule alone. The token ids never move.

Where a queue runs dry, one window is dealt in rounds of deficits and a new stretch begins with the shares of
those left. What does not fill a last window goes into sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from ._shared import Workspace, ship
from .tokens import codec, long_ids

WINDOW = 1024
#: A source of less than a 64th of all bytes shares a queue with others: at most 64 + 64 queues.
QUEUES = 64
#: Places of (partition, queue) that are broadcast at once; more go block by block of partitions.
BASES = 500_000
#: Windows of one stretch, so that products stay below 2^63.
STRETCH = 1 << 31


@dataclass
class Stretch:
    """`n` windows of `size` tokens, from sequence `first` on; gives[j] of base[j] on are queue j's tokens."""

    first: int
    n: int
    size: int
    base: list[int]
    gives: list[int]


def _share(total: int, weights: list[Fraction]) -> list[int]:
    """Whole parts of a total in proportion, by cumulative rounding."""
    every = sum(weights)
    at = [int(total * x / every) for x in accumulate(weights)]
    return [b - a for a, b in zip([0, *at[:-1]], at, strict=True)]


def _round_robin(left: list[int], weights: list[Fraction], size: int) -> list[int]:
    """One window of `size` tokens from queues of which some run dry: rounds of quantum and deficit."""
    out, deficit = [0] * len(left), [Fraction(0)] * len(left)
    while (free := size - sum(out)) > 0:
        live = [j for j, x in enumerate(left) if x > out[j] and weights[j] > 0] or [j for j, x in enumerate(left) if x > out[j]]
        every = sum(weights[j] or 1 for j in live)
        for j in live:
            deficit[j] += free * (weights[j] or 1) / every
            take = min(int(deficit[j]), left[j] - out[j], size - sum(out))
            out[j] += take
            deficit[j] -= take
        if size - sum(out) == free:  # only fractions: a token to the largest deficit
            j = max(live, key=lambda j: (deficit[j], -j))
            out[j] += 1
            deficit[j] -= 1
    return out


def stretches(tokens: list[int], weights: list[Fraction], window: int = WINDOW) -> list[Stretch]:
    """How all windows are dealt, for queues of so many tokens; at most a few a queue.

    A queue whose quantum is under one token waits until others have run dry.
    """
    left, base, first, out = list(tokens), [0] * len(tokens), 0, []

    def add(n: int, size: int, gives: list[int]) -> None:
        nonlocal first
        out.append(Stretch(first, n, size, list(base), gives))
        first += n
        for j, x in enumerate(gives):
            base[j] += x
            left[j] -= x

    while (rest := sum(left)) > 0:
        if rest < window:
            add(1, 1 << (rest.bit_length() - 1), _round_robin(left, weights, 1 << (rest.bit_length() - 1)))
            continue
        live = [w if x else Fraction(0) for w, x in zip(weights, left, strict=True)]
        live = live if sum(live) else [Fraction(bool(x)) for x in left]
        while any(0 < window * w < sum(live) for w in live):  # under a token a window; the largest always stay
            live = [w if window * w >= sum(live) else Fraction(0) for w in live]
        n = min(int(x * sum(live) / (window * w)) for w, x in zip(live, left, strict=True) if w)
        n = min(n, STRETCH, rest // window)
        if n:
            add(n, window, _share(n * window, live))
        else:
            add(1, window, _round_robin(left, weights, window))
    return out


class _Plan:
    """Stretches as arrays of whole numbers."""

    def __init__(self, plan: list[Stretch]):
        self.plan = plan
        self.high = [np.array([*accumulate(s.gives)], dtype=np.int64) for s in plan]

    def cut(self, queue: np.ndarray, begin: np.ndarray, n: np.ndarray):
        """Pieces of documents that lie at [begin, begin + n) of their queue: (document, start, length, sequence, offset)."""
        found = []
        for s, high in zip(self.plan, self.high, strict=True):
            base, gives = np.array(s.base, dtype=np.int64)[queue], np.array(s.gives, dtype=np.int64)[queue]
            lo, hi = np.maximum(begin, base) - base, np.minimum(begin + n, base + gives) - base
            d = np.flatnonzero(lo < hi)
            if not len(d):
                continue
            lo, hi, give, q = lo[d], hi[d], gives[d], queue[d]
            each = s.n / give
            w0 = np.clip(np.floor((lo - 1) * each).astype(np.int64) - 1, 0, s.n - 1)
            w1 = np.clip(np.floor(hi * each).astype(np.int64) + 1, 0, s.n - 1)
            many = w1 - w0 + 1
            i = np.repeat(np.arange(len(d)), many)
            w = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + w0[i]
            top = high[q[i]]
            low = top - give[i]

            def before(w, a, n=s.n):
                return w * (a // n) + w * (a % n) // n

            lower, lower_next = before(w, low), before(w + 1, low)
            here, after = before(w, top) - lower, before(w + 1, top) - lower_next
            a, b = np.maximum(here, lo[i]), np.minimum(after, hi[i])
            ok = np.flatnonzero(a < b)
            i, w, a, b = i[ok], w[ok], a[ok], b[ok]
            # in its window a queue stands behind those before it
            offset = lower_next[ok] - lower[ok] + a - here[ok]
            found.append((d[i], a + base[d[i]] - begin[d[i]], b - a, s.first + w, offset))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 5
        doc, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rest[0], doc))
        return doc[order], *(x[order] for x in rest)


def _queues(docs: DataFrame, text_col: str, source_col: str, targets: dict | None):
    """docs with `_queue`, and each queue's sources' share of the targets (None: by their tokens).

    A source of at least a QUEUESth of all bytes has a queue of its own; the others are dealt to as many
    queues as they are such shares, by hash.
    """
    size = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).alias("bytes"))
    every = size.agg(F.sum("bytes")).first()[0] or 0
    big = [r.s for r in size.where(F.col("bytes") * QUEUES >= every).orderBy(F.col("s").asc_nulls_first()).collect()]  # at most QUEUES
    rest = size.where(F.col("bytes") * QUEUES < every).agg(F.sum("bytes")).first()[0] or 0
    joint = max(1, rest * QUEUES // max(1, every))
    queue = F.lit(len(big)) + F.pmod(F.xxhash64(F.col(source_col).cast("string")), F.lit(joint)).cast("int")
    for i, s in enumerate(big):
        queue = F.when(F.col(source_col).cast("string").eqNullSafe(F.lit(s).cast("string")), i).otherwise(queue)
    weights = None
    if targets is not None:
        weights = [Fraction(targets.get(s, 0)) for s in big]
        small = sum((Fraction(x) for s, x in targets.items() if s not in big), Fraction(0))
        weights += [small / joint] * joint
    return docs.withColumn("_queue", queue), len(big) + joint, weights


def pack_documents(
    spark: SparkSession, docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict | None = None, window: int = WINDOW, end: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids its `ids` (little-endian 32-bit).

    path, ranks_path, pattern: the tokenizer, as for token_counts; each document's ids end with `end`. targets: share of each
    source (by name, null as None) in a window, whatever the sum; by default the sources' own shares
    of all tokens, so that all last to the end. Sources without a target come last. window is a power of two.
    Every token lies in one piece; sequences have `window` tokens, the last ones a power of two.

    Defined cases: null and empty texts are the end token alone; a null source is a source of its own; repeated
    rows and null ids each are packed; an empty table gives no rows; ids may be of any type; other columns are not read.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    ship(spark)
    ws = Workspace(spark, "packing")
    slim, n_queues, weights = _queues(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source")), "_text", "_source", targets)
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        from pyspark import TaskContext

        c, part, at = codec(path, ranks_path, pattern), TaskContext.get().partitionId(), [0] * n_queues
        wide = "<u2" if len(c.sizes) <= 1 << 16 and end < 1 << 16 else "<u4"
        for batch in batches:
            ids, places, sizes = [], [], []
            for text, q in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = long_ids(c, text) if text else []
                ids.append(np.array([*x, end], dtype=wide).tobytes())
                places.append(at[q])
                sizes.append(len(x) + 1)
                at[q] += len(x) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                ["_id", "queue", "part", "at", "n", "ids"],
            )

    held = slim.select("_id", "_text", F.col("_queue").cast("int")).mapInArrow(kernels.lean(encode), f"_id {kind}, queue int, part int, at long, n long, ids binary")
    held = ws.put(held, "tokens")
    parts = ws.put(held.groupBy("part", "queue").agg(F.sum("n").alias("n")), "parts")
    tokens = [0] * n_queues
    for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row a queue
        tokens[r.queue] = r.n
    plan = _Plan(stretches(tokens, weights or [Fraction(x) for x in tokens], window))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ws.put(parts.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    most = max(1, BASES // n_queues)
    last = parts.agg(F.max("part")).first()[0]

    def cut(batches):
        for batch in batches:
            n, raw = batch.column(3).to_numpy(), batch.column(4)
            doc, start, length, sequence, offset = plan.cut(batch.column(1).to_numpy(), batch.column(2).to_numpy(), n)
            size = [len(v) // k for v, k in zip(kernels.views(raw), n.tolist(), strict=True)]
            values = [v.view("<u2" if s == 2 else "<u4").astype("<u4").tobytes() for v, s in zip(kernels.views(raw), size, strict=True)]
            whole = [memoryview(v) for v in values]
            for i in range(0, len(doc), 10_000):
                j = slice(i, i + 10_000)
                pieces = [whole[d][a:b] for d, a, b in zip(doc[j].tolist(), (4 * start[j]).tolist(), (4 * (start + length)[j]).tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(doc[j])), start[j], length[j], [zlib.crc32(x) for x in pieces], n[doc[j]], sequence[j], offset[j]]
                out = [out[0], *(pa.array(x, pa.int64()) for x in out[1:])]
                yield pa.RecordBatch.from_arrays(out + [pa.array([bytes(x) for x in pieces], pa.binary())] * with_ids, [*names, "ids"][: len(out) + with_ids])

    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    shape = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    every = None
    for low in range(0, (last if last is not None else -1) + 1, most) or [0]:  # each block reads its own files of the tokens
        block = f"part >= {low} and part < {low + most}"
        placed = held.where(block).join(F.broadcast(bases.where(block)), ["part", "queue"]).select("_id", "queue", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
        pieces = placed.mapInArrow(kernels.lean(cut), shape)
        every = pieces if every is None else every.union(pieces)
    return every.withColumnRenamed("_id", id_col)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n, ids) from pieces that carry their ids: what a trainer reads, one row a sequence of at most a window's tokens."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", "n", F.expr("aggregate(p, X'', (s, x) -> s || x.ids)").alias("ids"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in sequences of 1,024 tokens, all in the sources' proportions."""
    import public_tokenizers

    from ..sources.tables import table

    return pack_documents(
        spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )
