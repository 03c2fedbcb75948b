"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters of 16 bytes, 8 apart, also see how far their window repeats
what stands some bytes before it (the best share of equal bytes over lags 2 to 32), so
that loops of any word are one feature. Filters are max-pooled over chunks of 64 windows;
neighbouring chunks overlap by 8 bytes and together cover the whole document. The mean and
the maximum over a document's chunks are combined into one probability. Weights are learned
by Adam on a bounded sample of labelled rows, on their whole texts; scoring reads whole texts,
each by itself. Texts over PIECE bytes are gone through piece by piece, with the bytes that
filters see around a piece, so memory follows the piece; the result is that of the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from ._shared import ship, unused

STEP, EMBED, FILTERS, CHUNK_WINDOWS = 8, 8, 24, 64
LAGS = range(2, 33)
_PAD = 40
_SLICE = 512 << 10
#: Bytes of a text that are laid out at once; a multiple of a chunk's bytes.
PIECE = 1 << 20
#: Most labelled rows of each class that are fitted.
ROWS_PER_CLASS = 1500
EPOCHS, BATCH, RATE = 14, 48, 0.01
MOST_WEIGHT = 4.0


class Laid:
    """Documents laid out for the filters: zero bytes between them, windows by document and chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = np.diff(offsets)
        blocks = np.maximum(1, -(-n // STEP))
        room = blocks * STEP + _PAD
        start = np.concatenate([[0], np.cumsum(room)]) + _PAD
        buf = np.zeros(start[-1] + _PAD, dtype=np.uint8)
        buf[np.arange(len(data)) + np.repeat(start[:-1] - offsets[:-1], n)] = data
        self.bytes = buf[: len(buf) // STEP * STEP]
        first = start[:-1] // STEP  # _PAD and room are multiples of STEP
        self.windows = np.repeat(first - np.cumsum(blocks) + blocks, blocks) + np.arange(blocks.sum())
        chunks = -(-blocks // CHUNK_WINDOWS)
        doc = np.repeat(np.arange(len(n)), chunks)
        nth = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.chunk_at = (np.cumsum(blocks) - blocks)[doc] + nth * CHUNK_WINDOWS
        self.doc_at = np.cumsum(chunks) - chunks
        self.chunks = chunks
        real = self.bytes != 0
        best = np.zeros(len(self.bytes) // STEP, dtype=np.uint8)
        for lag in LAGS:
            same = np.zeros(len(self.bytes), dtype=bool)
            np.equal(self.bytes[lag:], self.bytes[:-lag], out=same[lag:])
            same &= real
            # eight booleans are eight bytes of 0 or 1; one multiplication sums them
            by_step = (same.view(np.uint64) * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.uint8)
            by_step[:-1] += by_step[1:]
            np.maximum(best, by_step, out=best)
        self.repeat = best.astype(np.float32) * (4 / (2 * STEP)) - 2  # 2 in loops, about 0 and less in prose


def laid(texts: list[bytes]) -> Laid:
    return Laid(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def pieces(raw: np.ndarray):
    """A long text as layouts of PIECE bytes each, whose windows and chunks are those of the whole text."""
    for at in range(0, len(raw), PIECE):
        low = max(0, at - _PAD)
        x = Laid(raw[low : at + PIECE + STEP], np.array([0, min(len(raw), at + PIECE + STEP) - low]))
        n = -(-(min(len(raw), at + PIECE) - at) // STEP)
        x.windows = x.windows[(at - low) // STEP :][:n]
        x.chunk_at = np.arange(0, n, CHUNK_WINDOWS)
        x.chunks = np.array([len(x.chunk_at)])
        yield x


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "near": r.normal(0, 0.12, (STEP * EMBED, FILTERS)).astype(np.float32),
            "far": r.normal(0, 0.12, (STEP * EMBED, FILTERS)).astype(np.float32),
            "repeat": r.normal(0, 1.0, FILTERS).astype(np.float32),
            "bias": np.full(FILTERS, 0.1, dtype=np.float32),
            "mean": r.normal(0, 0.1, FILTERS).astype(np.float32),
            "max": r.normal(0, 0.1, FILTERS).astype(np.float32),
            "out": np.zeros(1, dtype=np.float32),
        }

    def _filters(self, x: Laid) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        e = p["embed"][x.bytes].reshape(-1, STEP * EMBED)
        a = e @ p["near"]
        a[:-1] += e[1:] @ p["far"]
        a += x.repeat[:, None] * p["repeat"]
        a += p["bias"]
        return e, np.maximum(a, 0, out=a)[x.windows]

    def _pool(self, x: Laid, a: np.ndarray):
        chunk = np.maximum.reduceat(a, x.chunk_at, axis=0)
        mean = np.add.reduceat(chunk, x.doc_at, axis=0) / x.chunks[:, None].astype(np.float32)
        top = np.maximum.reduceat(chunk, x.doc_at, axis=0)
        return chunk, mean, top

    def _sure(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        z = (mean * self.p["mean"] + top * self.p["max"]).sum(axis=1, dtype=np.float64) + float(self.p["out"][0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def scores(self, x: Laid) -> np.ndarray:
        _, mean, top = self._pool(x, self._filters(x)[1])
        return self._sure(mean, top)

    def _long(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(mean, maximum, chunks) of a text that is gone through piece by piece."""
        total, top, n = np.zeros((1, FILTERS)), np.zeros((1, FILTERS), dtype=np.float32), 0
        for x in pieces(raw):
            chunk, _, most = self._pool(x, self._filters(x)[1])
            total += chunk.sum(axis=0, dtype=np.float64)
            top = np.maximum(top, most)
            n += len(chunk)
        return (total / n).astype(np.float32), top, n

    def score_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts of any length."""
        out = []
        for a, b in K.slices(offsets, _SLICE):
            part = data[offsets[a] : offsets[b]]
            if len(part) > PIECE:  # one text
                mean, top, _ = self._long(part)
                out.append(self._sure(mean, top))
            else:
                out.append(self.scores(Laid(part, offsets[a : b + 1] - offsets[a])))
        return np.concatenate(out) if out else np.empty(0)

    def _back(self, x: Laid, e: np.ndarray, a: np.ndarray, chunk: np.ndarray, dc: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of what lies below the chunks, from the slopes of their maxima."""
        p = self.p
        size = np.diff(np.append(x.chunk_at, len(a)))
        of = np.repeat(np.arange(len(size)), size)
        da = np.where((a == chunk[of]) & (a > 0), dc[of], 0).astype(np.float32)
        wide = np.zeros((len(e), FILTERS), dtype=np.float32)
        wide[x.windows] = da
        g = {"near": e.T @ wide, "far": e[1:].T @ wide[:-1], "repeat": x.repeat @ wide, "bias": wide.sum(axis=0)}
        de = wide @ p["near"].T
        de[1:] += wide[:-1] @ p["far"].T
        de = de.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(x.bytes, weights=de[:, i], minlength=256) for i in range(EMBED)], axis=1)
        return g

    def gradient(self, x: Laid, y: np.ndarray, weight: np.ndarray, of: int | None = None) -> dict[str, np.ndarray]:
        """Slopes of the weighted loss of some texts, as a part of a batch of `of` texts."""
        p = self.p
        e, a = self._filters(x)
        chunk, mean, top = self._pool(x, a)
        d = ((self._sure(mean, top) - y) * weight / (of or len(y))).astype(np.float32)
        g = {"mean": mean.T @ d, "max": top.T @ d, "out": np.array([d.sum()])}
        each = np.repeat(np.arange(len(y)), x.chunks)
        dc = (d / x.chunks)[each, None] * p["mean"] + (chunk == top[each]) * (d[each, None] * p["max"])
        return g | self._back(x, e, a, chunk, dc)

    def long_gradient(self, raw: np.ndarray, y: float, weight: float, of: int) -> dict[str, np.ndarray]:
        """As gradient() for one text, piece by piece."""
        p = self.p
        mean, top, n = self._long(raw)
        d = np.float32((self._sure(mean, top)[0] - y) * weight / of)
        g = {"mean": mean[0] * d, "max": top[0] * d, "out": np.array([d])}
        for x in pieces(raw):
            e, a = self._filters(x)
            chunk = self._pool(x, a)[0]
            for k, v in self._back(x, e, a, chunk, d / n * p["mean"] + (chunk == top) * (d * p["max"])).items():
                g[k] = g.get(k, 0) + v
        return g

    def batch_gradient(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """As gradient(), with no more than PIECE bytes laid out at a time."""
        total: dict[str, np.ndarray] = {}
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for a, b in K.slices(offsets, PIECE):
            if b - a == 1 and len(texts[a]) > PIECE:
                part = self.long_gradient(np.frombuffer(texts[a], dtype=np.uint8), float(y[a]), float(weight[a]), len(texts))
            else:
                part = self.gradient(laid(texts[a:b]), y[a:b], weight[a:b], len(texts))
            for k, v in part.items():
                total[k] = total.get(k, 0) + v
        return total


def fit(texts: list[bytes], labels: list[int], weight_1: float = 1.0, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Learn from texts and 0/1 labels. weight_1: what a row of class 1 counts against one of class 0."""
    net = Network(seed)
    if not texts:
        net.p["mean"][:] = net.p["max"][:] = 0
        return net
    y = np.array(labels, dtype=np.float32)
    weight = np.where(y == 1, weight_1, 1).astype(np.float32)
    r = np.random.default_rng(seed)
    m = {k: np.zeros(v.shape) for k, v in net.p.items()}
    s = {k: np.zeros(v.shape) for k, v in net.p.items()}
    t = 0
    epochs = max(epochs, min(60, 800 * BATCH // len(texts)))  # few rows: as many steps
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        rate = RATE * (1 - epoch / epochs) + RATE / 50
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            t += 1
            for k, g in net.batch_gradient([texts[i] for i in part], y[part], weight[part]).items():
                g = g + 1e-4 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS
) -> Network:
    """Fit on the whole texts of at most rows_per_class labelled rows of each class, chosen by a hash of the id.

    Ids are of any type. Unlabelled rows and null labels are left out, as are null ids; an id that has
    two labels gets one of them. Without labelled rows every score is one half.
    """
    ship(spark)
    known = labels.where(f"`{label_col}` in (0, 1) and `{id_col}` is not null").select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.xxhash64(id_col).alias("h"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(rows_per_class)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = picked.groupBy("id").agg(F.min("y").alias("y"))  # at most 2 * rows_per_class
    got = texts.join(F.broadcast(picked), "id").select("id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), "y").collect()
    got.sort(key=lambda r: (r.id, r.raw))
    fitted = [sum(r.y == y for r in got) for y in (0, 1)]
    # the sample's classes are more even than the labels'; rows of class 1 count for what they stand for
    weight = n.get(1, 0) / max(1, fitted[1]) / max(1.0, n.get(0, 0) / max(1, fitted[0]))
    return fit([bytes(r.raw) for r in got], [r.y for r in got], min(MOST_WEIGHT, max(1.0, weight)))


def quality_scores(spark: SparkSession, docs: DataFrame, net: Network, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all by default) and score: the probability of label 1.

    Defined cases: null and empty texts get the score of no bytes; equal texts get equal
    scores; an empty table gives no rows; a column named score is replaced, others may have any name.
    """
    ship(spark)
    carry = [c for c in (carry if carry is not None else docs.columns) if c != "score"]

    def run(batches):
        for batch in batches:
            data, offsets = K.strings(batch.column(len(carry)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(net.score_of(data, offsets))], [*carry, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "score double"])
    return docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text_col}`").alias(unused(docs, "raw"))).mapInArrow(K.lean(run), schema)


HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"
THRESHOLD = 0.7


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score whole documents; rows whose crc32 remainder is 2 are never learned from."""
    from ..sources.tables import table

    docs = table(spark, sf_dir, "documents")
    net = train(spark, docs, table(spark, sf_dir, "labels").where(f"not ({HELD_OUT})"))
    out = quality_scores(spark, docs, net, carry=["doc_id"])
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
