"""Substring dedup over a log-structured fingerprint index.

Every window of `window` words is represented by its anchor: the least of its
word 8-grams by hash, the first of equal ones. Equal windows have equal anchors, and
neighbouring windows mostly share one, so an index of anchors (with the range of
window starts each stands for) holds about a fourteenth of all windows and misses none.

The index is log-structured. Each batch of documents gives one immutable run: a bucketed table
sorted by anchor, one row an anchor, with the place of its first occurrence and whether it has
more. A run is merge-joined with each earlier run as it lies; no row of history is moved or
sorted again. An anchor that occurs elsewhere makes its windows suspect, and a single occurrence
in an earlier run with them. When a level has `fanout` runs they are merged, two at a time, into
one of the next level. A manifest names the runs, so another session opens the index where
this one has left it.

Suspect windows are verified by 96 bits of two hashes over all their words. Each task settles the
windows that repeat within it and sends every other window once, so a passage that is
in a third of all documents reaches a reducer once from each task at most.
"""

from __future__ import annotations

import contextlib
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from ._shared import Workspace, partitions, release, ship, unused

GRAM = 8
FLUSH_WINDOWS = 1_500_000
_ANCHORS = "fp long, id long, lo int, n int"
_RUN = "fp bigint, id bigint, lo int, n int, many boolean"


def _anchors(w: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, fingerprint, first window start in it, windows) of each anchor in turn."""
    at, _ = w.windows(window)
    none = np.empty(0, dtype=np.int64)
    if not len(at):
        return none, none, none, none
    h, gram = w.hash, min(GRAM, window)
    n = len(h) - gram + 1
    g = np.zeros(n, dtype=K.U)
    for j in range(gram):
        g *= K.U(K._WORD_BASE)
        g += h[j : n + j]
    g = K.mix(g)
    low = (g & K.U(0xFFFFFFFF00000000)) | np.arange(n, dtype=K.U)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    chosen = (low[at] & K.U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
    doc = np.searchsorted(w.first, at[first], side="right") - 1
    return doc, g[chosen[first]].view(np.int64), at[first] - w.first[doc], np.diff(np.append(first, len(at)))


def _run_of(window: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, w in K.words_of(batch.column(1), K.SPACES, False):
                doc, fp, lo, n = _anchors(w, window)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ids[a + doc].astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["fp", "id", "lo", "n"])

    return K.lean(run)


@contextlib.contextmanager
def _sorted_buckets(spark: SparkSession):
    """Scans of bucketed tables say that a bucket of one file is sorted, as it was written."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class FingerprintIndex:
    """Sorted immutable runs of anchors in a folder that all executors share.

    A folder without a manifest is a new index; else the index that is there is opened, with its
    own window, fanout and number of buckets. One session at a time may add to it.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 35, fanout: int = 2, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.ws = Workspace.at(spark, self.path)
        self.name = "tidewell_" + hashlib.md5(self.path.encode()).hexdigest()
        last = max((json.loads(r.value) for r in self._manifests()), key=lambda x: x["version"], default=None)
        self.state = last or {"version": 0, "window": window, "fanout": fanout, "buckets": buckets or partitions(spark), "made": 0, "levels": [[]]}

    def _manifests(self) -> list:
        if not self.ws.exists("manifest"):
            return []
        return self.spark.read.text(f"{self.path}/manifest").collect()  # a line an add

    @property
    def levels(self) -> list[list[str]]:
        return self.state["levels"]

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table over its files."""
        table = f"{self.name}_{name}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({_RUN}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame, dealt: bool) -> str:
        self.state["made"] += 1
        name = f"run{self.state['made']}"
        n = self.state["buckets"]
        rows = rows if dealt else rows.repartition(n, "fp")
        with _sorted_buckets(self.spark):
            rows.sortWithinPartitions("fp").write.mode("overwrite").bucketBy(n, "fp").sortBy("fp").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(f"{self.name}_{name}")
        return name

    def _forget(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{name}")

    def _commit(self) -> None:
        self.state["version"] += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    def met(self, old: str, new: str) -> DataFrame:
        """The rows of one run whose anchors another has: a merge join of buckets."""
        return self.run(old).hint("merge").join(self.run(new).select("fp"), "fp")

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one: the first run's place of an anchor that both have."""
        x, y = self.run(a), self.run(b).toDF("fp", "id2", "lo2", "n2", "many2")
        many = (F.col("many").isNotNull() & F.col("many2").isNotNull()) | F.coalesce("many", F.lit(False)) | F.coalesce("many2", F.lit(False))
        return x.hint("merge").join(y, "fp", "full").select("fp", F.coalesce("id", "id2").alias("id"), F.coalesce("lo", "lo2").alias("lo"), F.coalesce("n", "n2").alias("n"), many.alias("many"))

    def add(self, docs: DataFrame) -> DataFrame:
        """Index (id, text) rows; the window ranges (id, lo, n), old and new, that this batch makes suspect.

        An id stands for one text. The ranges are a table in the index's folder, kept until remove().
        """
        k = self.state["version"] + 1
        fresh = self.ws.put(docs.mapInArrow(_run_of(self.state["window"]), _ANCHORS), f"anchors{k}")
        place = fresh.groupBy("fp").agg(F.min(F.struct("id", "lo", "n")).alias("first"), (F.count("*") > 1).alias("many"))
        name = self._write(place.select("fp", "first.*", "many"), dealt=False)
        twice = self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}").where("many").select("fp")
        before = None
        if self.runs():
            with _sorted_buckets(self.spark):
                for i, old in enumerate(self.runs()):
                    hits = self.ws.put(self.met(old, name), f"hits{k}-{i}")
                    before = hits if before is None else before.union(hits)
            twice = twice.union(before.select("fp")).distinct()
        # The anchors' keys are a table of their own, so that the join has two plain sides and a hot one can be split.
        twice = self.ws.put(twice, f"twice{k}")
        found = fresh.join(twice, "fp", "left_semi").select("id", "lo", "n")
        if before is not None:
            found = found.union(before.where("not many").select("id", "lo", "n"))
        found = self.ws.put(found, f"suspects{k}")
        hits = [f"hits{k}-{i}" for i in range(len(self.runs()))]
        self.levels[0].append(name)
        gone = self._compact()
        self._commit()
        self._forget(*gone)
        self.ws.drop(f"anchors{k}", f"twice{k}", *hits, *gone)
        return found

    def _compact(self) -> list[str]:
        """Merge full levels upwards; the names of the runs that are no longer needed."""
        gone: list[str] = []
        i = 0
        while i < len(self.levels):
            if len(self.levels[i]) >= self.state["fanout"]:
                left = self.levels[i]
                while len(left) > 1:
                    with _sorted_buckets(self.spark):
                        pairs = [left[j : j + 2] for j in range(0, len(left), 2)]
                        gone += [r for p in pairs if len(p) == 2 for r in p]
                        left = [self._write(self.merged(*p), dealt=True) if len(p) == 2 else p[0] for p in pairs]
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1] += left
            i += 1
        return gone

    def close(self) -> None:
        """Take the runs' names out of the session's catalog; the files stay."""
        self._forget(*self.runs())

    def remove(self) -> None:
        """Delete the index with its files."""
        self.close()
        self.ws.drop(*self.runs(), "manifest")


def _runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, first, count) of each run of consecutive starts; input sorted by id and start."""
    if not len(ids):
        return ids, starts, starts
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + 1)]))
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], starts[first], starts[last] - starts[first] + 1


def _grouped(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that puts equal pairs (h, g) side by side, whether each is equal to the next)."""
    o = np.argsort(h, kind="stable")
    same, also = h[o[1:]] == h[o[:-1]], g[o[1:]] == g[o[:-1]]
    if (same & ~also).any():  # one half equal, the other not
        o = np.lexsort((g, h))
        same, also = h[o[1:]] == h[o[:-1]], g[o[1:]] == g[o[:-1]]
    return o, same & also


def _suspect_windows(window: int, buckets: int):
    """Hashes of suspect windows, dealt into buckets; windows that repeat in the task are settled here."""

    def packed(ids, starts, hashes, more):
        o, same = _grouped(hashes, more)
        new = np.concatenate([[True], ~same])
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1
        settled = np.sort(o[many[group]])
        sent = np.sort(o[new])
        alone = np.ones(len(ids), dtype=bool)
        alone[settled] = False
        bucket = (hashes >> K.U(20)).astype(np.int64) % buckets
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        edges = np.searchsorted(bucket[sent], np.arange(buckets + 1))
        rows: list[list] = [[], [], [], [], [], [], []]

        def row(b, keys, docs, at, single, kind, rest=None):
            cut = np.concatenate([[0], np.flatnonzero(docs[1:] != docs[:-1]) + 1])
            rows[0].append(b)
            rows[1].append(docs[cut].tobytes())
            rows[2].append(np.diff(np.append(cut, len(docs))).astype(np.uint32).tobytes())
            rows[3].append(at.astype(np.int32).tobytes())
            rows[4].append(keys.tobytes() if kind else single.astype(np.int32).tobytes())
            rows[5].append(np.packbits(single.astype(bool)).tobytes() if kind else None)
            rows[6].append(rest.tobytes() if kind else None)

        for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if x < y:
                part = sent[x:y]
                row(b, hashes[part], ids[part], starts[part], alone[part], True, more[part])
        if len(settled):
            so = np.lexsort((starts[settled], ids[settled]))
            i, s, n = _runs(ids[settled][so], starts[settled][so])
            deal = (K.mix(i.astype(K.U)) % K.U(buckets)).astype(np.int64)
            o = np.argsort(deal, kind="stable")
            i, s, n, deal = i[o], s[o], n[o], deal[o]
            edges = np.searchsorted(deal, np.arange(buckets + 1))
            for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if x < y:
                    row(b, None, i[x:y], s[x:y], n[x:y], False)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "ids", "counts", "starts", "data", "alone", "more"])

    def run(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ranges = batch.column(2)
            at = ranges.offsets.to_numpy().astype(np.int64)
            flat = ranges.values
            lo, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for a, b, w in K.words_of(batch.column(1), K.SPACES, False):
                start, h = w.windows(window)
                if not len(start):
                    continue
                _, g = w.windows(window, second=True)
                x, y = at[a], at[b]
                doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                begin = w.first[doc] + lo[x:y]
                step = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + size[x:y], -1)
                ok = np.cumsum(step)[start] > 0
                start, h, g = start[ok], h[ok], (g[ok] >> K.U(32)).astype(np.uint32)
                d = np.searchsorted(w.first, start, side="right") - 1
                held.append((ids[a + d].astype(np.int64), start - w.first[d], h, g))
                n += len(h)
                if n >= FLUSH_WINDOWS:
                    yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return K.lean(run)


def _settle(key, table):
    """Window ranges that occur elsewhere: those settled by tasks, and those two tasks sent."""
    ids, starts, hashes, alone, more = [], [], [], [], []
    out: list[list] = [[], [], []]
    cols = (table.column(c).to_pylist() for c in ("ids", "counts", "starts", "data", "alone", "more"))
    for i, c, s, data, one, rest in zip(*cols, strict=True):
        i = np.repeat(np.frombuffer(i, dtype=np.int64), np.frombuffer(c, dtype=np.uint32))
        s = np.frombuffer(s, dtype=np.int32)
        if one is None:
            for x, y in zip(out, (i, s, np.frombuffer(data, dtype=np.int32)), strict=True):
                x.append(y)
        else:
            ids.append(i)
            starts.append(s)
            hashes.append(np.frombuffer(data, dtype=K.U))
            alone.append(np.unpackbits(np.frombuffer(one, dtype=np.uint8), count=len(i)).astype(bool))
            more.append(np.frombuffer(rest, dtype=np.uint32))
    if ids:
        i, s, h, one, g = (np.concatenate(x) for x in (ids, starts, hashes, alone, more))
        o, same = _grouped(h, g)
        twin = np.zeros(len(h), dtype=bool)
        twin[1:] |= same
        twin[:-1] |= same
        o = o[twin]
        o = o[one[o]]
        o = o[np.lexsort((s[o], i[o]))]
        for x, y in zip(out, _runs(i[o], s[o]), strict=True):
            x.append(y)
    a, b, c = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out)
    K.trim()
    return pa.table({"id": pa.array(a.astype(np.int64)), "lo": pa.array(b.astype(np.int32)), "n": pa.array(c.astype(np.int32))})


def _row_key(id_col: str, text_col: str):
    """A row's key: a hash of its id, null or not, and its text, so rows of one key are equal in both."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_row_key(id_col, text_col).alias("id"), F.col(f"`{text_col}`").alias("text"))


def _verified(ws: Workspace, slim: DataFrame, suspects: DataFrame, window: int, name: str = "windows") -> DataFrame:
    """(id, lo, n): of the suspect ranges, the window starts whose words also start somewhere else."""
    by_doc = suspects.groupBy("id").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))
    buckets = min(1 << 20, 4 * partitions(ws.spark))
    packed = "bucket int, ids binary, counts binary, starts binary, data binary, alone binary, more binary"
    sent = slim.join(by_doc, "id").select("id", "text", "ranges").mapInArrow(_suspect_windows(window, buckets), packed)
    return ws.put(sent.groupBy("bucket").applyInArrow(_settle, "id long, lo int, n int"), name)


def repeated_windows(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, batches: int = 2, fanout: int = 2
) -> DataFrame:
    """(id, lo, n): ranges of window starts whose word sequence also starts somewhere else.

    The documents are indexed in `batches` batches, as they would arrive one after
    another. Ranges may come in pieces but do not repeat a start within a piece. id is
    the row's key as _row_key gives it.
    """
    ship(spark)
    ws = Workspace(spark, "substrings")
    slim = _keyed(docs, id_col, text_col)
    index = FingerprintIndex(spark, f"{ws.path}/index", window, fanout)
    suspects = None
    for b in range(batches):
        part = slim.where(F.pmod("id", F.lit(batches)) == b) if batches > 1 else slim
        found = index.add(part)
        suspects = found if suspects is None else suspects.union(found)
        release(spark)
    index.remove()
    out = _verified(ws, slim, suspects, window)
    ws.drop("index")
    release(spark)
    return out


def _cut(window: int, carry: list[str], text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_cut, digest, kept_text = [], [], [], []
            for raw, ranges in zip(batch.column(len(carry)).to_pylist(), batch.column(len(carry) + 1).to_pylist(), strict=True):
                words = (raw or "").encode().split()
                n_words.append(len(words))
                if ranges:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, [r["lo"] for r in ranges], 1)
                    np.add.at(step, [min(r["lo"] + r["n"] + window - 1, len(words)) for r in ranges], -1)
                    stay = np.cumsum(step)[:-1] <= 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_cut.append(n_words[-1] - len(words))
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode() if text else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(carry))), pa.array(n_words, pa.int64()), pa.array(n_cut, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept_text, pa.string())] if text else [])],
                [*carry, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if text else [])],
            )

    return K.lean(run)


def substring_dedup(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    batches: int = 2,
    fanout: int = 2,
    carry: list[str] | None = None,
    text: bool = True,
) -> DataFrame:
    """Documents with the words of repeated windows removed.

    Returns the columns `carry` (all but the text by default), n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and, if `text`, kept_text.
    Words are runs of `[^\\x20\\x09-\\x0D]`, unchanged; a word goes when a window of `window`
    words that covers it also starts elsewhere, in this document or another. All windows
    are judged on the input.

    Defined cases: null and empty texts have no words; texts under `window` words keep
    all; repeated documents lose all words that windows cover; rows with one id and
    different texts are different rows, and ids may be null or of any type; an empty table gives
    no rows; columns of docs named like a result are left out, others may have any name.
    """
    made = {"n_words", "n_removed", "kept_sha256", "kept_text"}
    carry = [c for c in (carry if carry is not None else [c for c in docs.columns if c != text_col]) if c not in made]
    key, raw, cut = unused(docs, "key"), unused(docs, "raw"), unused(docs, "ranges")
    found = repeated_windows(spark, docs, id_col, text_col, window, batches, fanout)
    ranges = found.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("lo", "n")).alias(cut))
    own = [F.col(f"`{c}`") for c in carry]
    base = docs.select(*own, F.col(f"`{text_col}`").alias(raw), _row_key(id_col, text_col).alias(key))
    wide = base.join(ranges, key, "left").select(*own, raw, cut)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if text else "")])
    return wide.mapInArrow(_cut(window, carry, text), schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, windows of 35 words."""
    from ..sources.tables import table

    return substring_dedup(spark, table(spark, sf_dir, "documents"), carry=["doc_id"], text=False)
