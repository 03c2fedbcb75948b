"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. Every hash
flips one bit of a sketch, so the Hamming distance of two sketches is at most the
sets' symmetric difference; and sets that link at t differ in at most
(a + b)(1 - t)/(1 + t) shingles. The join goes by pigeonhole on that bound:

* Sizes fall into bands that grow by 1/t, so a set meets only its own band and the
  next one. In a band the hash space is cut into slices; a slice's key is the XOR of
  the hashes in it (a slice of an arbitrarily long parity sketch, folded to 64 bits).
  Two sets that differ in d shingles agree in every slice no difference falls into.
* There are more slices than differences, in every band, so that some slice surely agrees.
* An empty slice says nothing and gives no key, so there are as many slices more as sets of the
  band usually leave empty. A set with so many empty slices that the certainty is gone is cut
  again by another seed; only one that fails under all seeds gives keys for its empty
  slices too. Of two sets that link, the first that fails no more makes the other's key certain,
  as both are cut by every seed up to there. No link depends on chance, but for hash collisions.

Sets equal in content are one class from the start. Classes that share a key are
candidates; keys that the same classes share are one from then on. First each member of a key meets the member that shares the most keys overall,
usually the text the others were made from; pairs that sizes and sketches leave possible are
verified on whole sets, and linked classes merge. Then each class outside its key's largest
component meets the class of another component whose sketch is nearest (in keys of few members:
all that are near), ROUNDS times.
At last all pairs of classes that share a key and are still in two components are compared
by their sketches, inside the tasks, in blocks of at most BLOCK members; only pairs within
the bound leave a task, to be verified in the same way. What lies in one component already needs no further proof, so a group of n
copies costs about n verified pairs and no link between components is lost.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from ._shared import Workspace, partitions, release, ship
from .components import components

SEEDS = 6
FLUSH_KEYS = 500_000
#: Ids that may be broadcast to select the texts of candidates; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of one key that are compared in one piece with as many others.
BLOCK = 512
#: Rows of one component's keys that are compared in one place, where repeats of a pair are seen.
TOGETHER = 1000
#: Bytes of a key that travel, beside its bucket: keys that are equal in them only by chance give candidates, which are verified.
KEY_BYTES = 5
#: Keys that one bucket takes; the number of buckets follows the shingles counted before.
BUCKET_KEYS = 1_000_000
#: Times that the keys are made, each time those of other buckets, so that the disk holds one part of them at once.
PASSES = 2
ROUNDS = 1
_SEED = [K.U(0)] + [K.U(0xD6E8FEB86659FD93 * (i + 1) & K._MASK) for i in range(SEEDS - 1)]


def differ(total: int, percent: int) -> int:
    """Most shingles in which two sets of `total` shingles together can differ and still link."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, last size, slices) of each band up to the size `largest` and one more.

    A set of fewer than `100 / (100 - percent) - 1` shingles links only with its equals. A band
    has so many slices that most of its sets leave fewer empty than spare() allows; the others are
    cut again, so the number is a matter of cost alone.
    """
    starts = [max(1, -(-percent // (100 - percent)))]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent)))
    starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent)))
    lasts = [b - 1 for b in [*starts[1:], -(-starts[-1] * 100 // percent)]]
    cut = []
    for a, last in zip(starts, lasts, strict=True):
        d = differ(2 * last, percent)
        p = d + 2
        if d >= 20:
            some = np.unique(np.linspace(-(-a * percent // 100), last, 9).astype(np.int64))

            def enough(p: int, some=some, last=last) -> bool:
                empty = p * (1 - 1 / p) ** some
                return bool((spare(some, last, p, percent) >= empty + 2 * np.sqrt(empty)).all())

            while not enough(p):
                p += max(1, p // 128)
        cut.append(p)
    return np.array(starts), np.array(lasts), np.array(cut)


def spare(size: np.ndarray, last: np.ndarray | int, cut: np.ndarray | int, percent: int) -> np.ndarray:
    """Empty slices that a set may have and still surely share a filled one with whatever links to it.

    A partner has at most 100 / percent times its size and the band's last size; differences
    touch at most as many slices as there are, and of the rest one more than this is left.
    """
    partner = np.minimum(last, size * 100 // percent)
    return cut - (size + partner) * (100 - percent) // (100 + percent) - 1


class Sets:
    """Distinct shingle hashes of some documents, each ascending: hash[at[d]:at[d+1]]."""

    def __init__(self, w: K.Words, words: int):
        n = w.counts
        size = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(size)])
        h = np.empty(at[-1], dtype=K.U)
        long = np.repeat(n >= words, size)
        h[long] = w.windows(words)[1]
        short = np.flatnonzero((n > 0) & (n < words))
        if len(short):
            h[at[short]] = w.whole(short)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a > 1:
                h[a:b].sort()
        keep = np.ones(len(h), dtype=bool)
        if len(h):
            keep[1:] = h[1:] != h[:-1]
            keep[at[:-1][size > 0]] = True
        run = np.concatenate([[0], np.cumsum(keep)])
        self.hash, self.at = h[keep], run[at]
        self.n = np.diff(self.at)

    def digest(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set, 0 for empty ones."""
        full = np.flatnonzero(self.n)
        s = np.zeros((2, len(self.n)), dtype=K.U)
        if len(full):
            s[0, full] = np.add.reduceat(self.hash, self.at[full])
            s[1, full] = np.bitwise_xor.reduceat(K.mix(self.hash * K.U(0x9FB21C651E98DF25)), self.at[full])
        return s[0].view(np.int64), s[1].view(np.int64)

    def sketch(self, percent: int) -> list[bytes]:
        """One-bit-per-hash parity sketches of 2**k bits, 16 or more per difference the set allows."""
        out = []
        for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            bits = 64
            while bits < 16 * differ(2 * (b - a), percent):
                bits *= 2
            flips = np.bincount((self.hash[a:b] >> K.U(7) & K.U(bits - 1)).astype(np.int64), minlength=bits) & 1
            out.append(np.packbits(flips.astype(bool)).tobytes())
        return out

    def keys(self, docs: np.ndarray, band: np.ndarray, cut: np.ndarray, spare: np.ndarray, last: bool, seed: int):
        """(document, key) pairs of one seed, and the documents with more empty slices than spare."""
        size = self.n[docs]
        base = np.concatenate([[0], np.cumsum(cut)])
        which = np.repeat(np.arange(len(docs)), size)
        tok = self.hash[np.repeat(self.at[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        g = K.mix(tok ^ _SEED[seed]) if seed else tok
        cell = base[which] + ((g >> K.U(32)) * cut.astype(K.U)[which] >> K.U(32)).astype(np.int64)
        if seed:
            o = np.argsort(cell, kind="stable")
            cell, tok, which = cell[o], tok[o], which[o]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, dtype=np.int64)
        x = np.bitwise_xor.reduceat(tok, first) if len(first) else np.empty(0, dtype=K.U)
        doc, cell = which[first], cell[first]
        empty = cut - np.bincount(doc, minlength=len(docs))
        bad = empty > spare
        if last and bad.any():
            hole = np.ones(base[-1], dtype=bool)
            hole[cell] = False
            hole &= np.repeat(bad, cut)
            more = np.flatnonzero(hole)
            cell = np.concatenate([cell, more])
            x = np.concatenate([x, np.zeros(len(more), dtype=K.U)])
            doc = np.concatenate([doc, np.searchsorted(base, more, side="right") - 1])
        slot = (band[doc].astype(K.U) << K.U(40)) | (K.U(seed) << K.U(36)) | (cell - base[doc]).astype(K.U)
        return docs[doc], K.mix(x ^ K.mix(slot + K.U(1))), docs[bad]


def all_keys(s: Sets, docs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) pairs of the given documents in their own band and the next."""
    starts, lasts, cut = bands(percent, 1 << max(10, int(s.n.max(initial=1)).bit_length()))
    docs = docs[s.n[docs] >= starts[0]]
    own = np.searchsorted(starts, s.n[docs], side="right") - 1
    out_d, out_k = [], []
    for step in (0, 1):
        band = own + step
        reach = np.ones(len(docs), dtype=bool) if not step else s.n[docs] * 100 // percent >= starts[band]
        left, at = docs[reach], band[reach]
        for seed in range(SEEDS):
            if not len(left):
                break
            last = seed == SEEDS - 1
            d, k, bad = s.keys(left, at, cut[at], spare(s.n[left], lasts[at], cut[at], percent), last, seed)
            out_d.append(d)
            out_k.append(k)
            keep = np.isin(left, bad)
            left, at = left[keep], at[keep]
    if not out_d:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=K.U)
    return np.concatenate(out_d), np.concatenate(out_k)


def _classes(words: int, percent: int):
    """Per document: set size, set digests, sketch."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for _, _, w in K.words_of(batch.column(1), K.SPACES, True):
                s = Sets(w, words)
                a, b = s.digest()
                cols[0].append(s.n)
                cols[1].append(a)
                cols[2].append(b)
                cols[3] += s.sketch(percent)
            n, a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in cols[:3])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), pa.array(cols[3], pa.binary())], ["id", "n", "s1", "s2", "sketch"])

    return K.lean(run)


def _steps(x: np.ndarray) -> bytes:
    """Numbers as the first one and the steps from each to the next, in as few bytes as hold all of them; the first byte says how many."""
    step = np.diff(x)
    for kind in (np.int8, np.int16, np.int32):
        if not len(step) or (np.iinfo(kind).min <= step.min() and step.max() <= np.iinfo(kind).max):
            break
    else:
        kind = np.int64
    return bytes([np.dtype(kind).itemsize]) + x[:1].tobytes() + step.astype(kind).tobytes()


def _of_steps(b: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(b, np.int64, 1, 1), np.frombuffer(b, f"i{b[0]}", -1, 9)]), dtype=np.int64)


def _keyed(words: int, percent: int, buckets: int, part: int = 0, parts: int = 1):
    """Keys, dealt into buckets and packed by document: 4 bytes and the set's digest a document, its id in steps, and KEY_BYTES a key.

    part: only the buckets that are part modulo parts.
    """

    def packed(ids, sigs, keys):
        low = (keys & K.U(0xFFFFFFFF)).astype(np.int64) % buckets
        o = np.argsort(low, kind="stable")
        low, ids, sigs, keys = low[o], ids[o], sigs[o], keys[o] >> K.U(64 - 8 * KEY_BYTES)
        edges = np.searchsorted(low, np.arange(buckets + 1))
        rows: list[list] = [[], [], [], [], []]
        for bucket, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if a < b:
                new = np.concatenate([[0], np.flatnonzero((ids[a + 1 : b] != ids[a : b - 1]) | (sigs[a + 1 : b] != sigs[a : b - 1])) + 1])
                rows[0].append(bucket)
                rows[1].append(_steps(ids[a:b][new]))
                rows[2].append(sigs[a:b][new].tobytes())
                rows[3].append(np.diff(np.append(new, b - a)).astype(np.uint32).tobytes())
                rows[4].append(np.ascontiguousarray(keys[a:b].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "ids", "sigs", "counts", "keys"])

    def run(batches):
        done: set[int] = set()  # classes this task has given already
        held: list[tuple] = []
        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, w in K.words_of(batch.column(1), K.SPACES, True):
                s = Sets(w, words)
                sig, _ = s.digest()
                new = []
                for d in np.flatnonzero(s.n).tolist():
                    if (x := int(sig[d])) not in done:
                        done.add(x)
                        new.append(d)
                d, k = all_keys(s, np.array(new, dtype=np.int64), percent)
                if parts > 1:
                    own = (k & K.U(0xFFFFFFFF)).astype(np.int64) % buckets % parts == part
                    d, k = d[own], k[own]
                o = np.argsort(d, kind="stable")
                held.append((ids[a + d[o]].astype(np.int64), sig[d[o]], k[o]))
                n += len(k)
                if n >= FLUSH_KEYS:
                    yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return K.lean(run)


def _shared_keys(key, table):
    """The sets of classes that share a key: of each a number that follows from its classes, its members, and the keys they share.

    Keys with the same members tell the same pairs, so they are one, here and, by the number, in all buckets.
    Two sets that had one number by chance would be one larger set: more candidates, none less.
    """
    ids, sigs, counts, keys = [], [], [], []
    for i, s, c, k in zip(*(table.column(x).to_pylist() for x in ("ids", "sigs", "counts", "keys")), strict=True):
        c = np.frombuffer(c, dtype=np.uint32)
        ids.append(np.repeat(_of_steps(i), c))
        sigs.append(np.frombuffer(s, dtype=np.int64))
        counts.append(c)
        wide = np.zeros((int(c.sum()), 8), dtype=np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(k, dtype=np.uint8).reshape(-1, KEY_BYTES)
        keys.append(wide.view(np.int64).ravel())
    # Whole digests become numbers in this table, of half their width, before they are repeated for each key.
    digests, s = np.unique(np.concatenate(sigs), return_inverse=True)
    s = np.repeat(s.astype(np.int32), np.concatenate(counts))
    i, k = np.concatenate(ids), np.concatenate(keys)
    o = np.argsort(k)
    k = k[o]
    twin = np.zeros(len(k), dtype=bool)
    same = k[1:] == k[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    o, k = o[twin], k[twin]
    i, s = i[o], s[o]
    o = np.lexsort((i, s, k))
    i, s, k = i[o], s[o], k[o]
    if len(k):
        keep = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        i, s, k = i[keep], s[keep], k[keep]
    inner = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.empty(0, dtype=bool)
    keep = inner.copy()
    keep[:-1] |= inner[1:]
    i, s, k = i[keep], s[keep], k[keep]
    number, times = np.empty(0, dtype=K.U), np.empty(0, dtype=np.int64)
    if len(k):
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        sets = K.mix(np.add.reduceat(K.mix(digests.view(K.U) ^ K.U(0x9FB21C651E98DF25))[s], first) + size.astype(K.U))
        sets, at, times = np.unique(sets, return_index=True, return_counts=True)
        row = np.repeat(first[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
        i, number, times = i[row], np.repeat(sets, size[at]), np.repeat(times, size[at])
    K.trim()
    return pa.table({"key": pa.array(number.view(np.int64)), "id": pa.array(i), "keys": pa.array(times.astype(np.int64))})


def _packed_sets(words: int):
    def run(batches):
        for batch in batches:
            for x, y, w in K.words_of(batch.column(1), K.SPACES, True):
                s = Sets(w, words)
                sets = [s.hash[a:b].tobytes() for a, b in zip(s.at[:-1].tolist(), s.at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(sets, pa.binary())], ["id", "set"])

    return K.lean(run)


class Sketches:
    """The sketches of some sets, by length, and how far pairs of them are apart."""

    #: A sketch folded to this part of its bits rules most pairs out.
    COARSE = 4

    def __init__(self, sketches: pa.Array, n: np.ndarray, percent: int):
        self.n, self.percent = n, percent
        rows = K.views(sketches)
        self.size = np.array([len(x) for x in rows], dtype=np.int64)
        self.at = np.empty(len(rows), dtype=np.int64)
        self.of = {}
        for size in np.unique(self.size).tolist():
            which = np.flatnonzero(self.size == size)
            self.at[which] = np.arange(len(which))
            self.of[size] = np.stack([rows[i] for i in which.tolist()]).view(K.U)

    def _folded(self, size: int, which: np.ndarray, to: int) -> np.ndarray:
        """Bit i is hash mod the number of bits, so halves fold by XOR."""
        x = self.of[size][self.at[which]]
        return np.bitwise_xor.reduce(x.reshape(len(x), size // to, to // 8), axis=1) if size > to else x

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sizes of pairs of sets allow a link."""
        a, b = self.n[i], self.n[j]
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs whose sketches do not rule a link out, and their distances over their sizes."""
        places, apart = [], []
        kinds = self.size[i] * (1 << 32) + self.size[j]
        for kind in np.unique(kinds).tolist():
            a, b = kind >> 32, kind & 0xFFFFFFFF
            size = min(a, b)
            part = np.flatnonzero(kinds == kind)
            step = max(1, (1 << 22) // max(a, b))
            for at in range(0, len(part), step):
                p = part[at : at + step]
                total = self.n[i[p]] + self.n[j[p]]
                for to in (max(8, size // self.COARSE), size):
                    far = np.bitwise_count(self._folded(a, i[p], to) ^ self._folded(b, j[p], to)).sum(axis=1, dtype=np.int64)
                    ok = far * (100 + self.percent) <= total * (100 - self.percent)
                    p, total, far = p[ok], total[ok], far[ok]
                places.append(p)
                apart.append(far / total)
        if not places:
            return np.empty(0, dtype=np.int64), np.empty(0)
        return np.concatenate(places), np.concatenate(apart)


def _near(percent: int):
    """Pairs whose sketches do not rule a link out."""

    def run(batches):
        for batch in batches:
            at = np.arange(batch.num_rows)
            n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            both = Sketches(pa.concat_arrays([batch.column("xa"), batch.column("xb")]), n, percent)
            keep = np.zeros(len(at), dtype=bool)
            keep[both.near(at, at + len(at))[0]] = True
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return K.lean(run)


#: Members of a key up to which all its pairs are listed at once, together with those of other keys.
FEW = 32


def _apart(percent: int, nearest: bool):
    """Pairs of one key in two components whose sizes and sketches do not rule a link out.

    nearest: of keys with more than FEW members only the nearest one of each member outside the
    key's largest component.
    """

    def listed(unit: np.ndarray, set_of: np.ndarray, few: np.ndarray):
        """All pairs of sets that share one of the marked keys; rows ascend by unit."""
        row = np.flatnonzero(few)
        unit, row = unit[row], set_of[row]
        a, b = [], []
        for k in range(1, FEW):
            same = np.flatnonzero(unit[k:] == unit[:-k])
            if not len(same):
                break
            a.append(row[same])
            b.append(row[same + k])
        return (np.concatenate(a), np.concatenate(b)) if a else (row[:0], row[:0])

    def run(key, table):
        rep, label, n = (table.column(c).to_numpy() for c in ("rep", "label", "n"))
        sketches = Sketches(table.column("sketch").combine_chunks(), n, percent)
        units = table.column("units").combine_chunks()
        set_of = np.repeat(np.arange(len(rep)), np.diff(units.offsets.to_numpy()))
        unit, kind = units.flatten().field(0).to_numpy(), units.flatten().field(1).to_numpy()
        o = np.argsort(unit, kind="stable")
        unit, kind, set_of = unit[o], kind[o], set_of[o]
        cut = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
        size = np.diff(cut)
        few = np.repeat((size <= FEW) & (np.maximum.reduceat(kind, cut[:-1]) == 0), size)
        found = []

        def keep(i, j):
            ok = (label[i] != label[j]) & sketches.possible(i, j)
            i, j = i[ok], j[ok]
            if len(i):
                # one pair may share many keys
                pair = np.unique(np.minimum(i, j) * len(rep) + np.maximum(i, j))
                i, j = pair // len(rep), pair % len(rep)
                near, far = sketches.near(i, j)
                return i[near], j[near], far
            return i, j, np.empty(0)

        i, j = listed(unit, set_of, few)
        for at in range(0, len(i), 1 << 20):
            found.append(keep(i[at : at + (1 << 20)], j[at : at + (1 << 20)])[:2])
        for x, y in zip(cut[:-1][size > 1].tolist(), cut[1:][size > 1].tolist(), strict=True):
            if few[x]:
                continue
            part, side = set_of[x:y], kind[x:y]
            names, of = np.unique(label[part], return_inverse=True)
            odd = of != np.bincount(of).argmax()  # two sets in two components are not both in the largest
            if side.max():
                one, two = side == 1, side == 2
                meetings = [(part[one & odd], part[two]), (part[one & ~odd], part[two & odd])]
            else:
                meetings = [(part[odd], part)]
            for first, second in meetings:
                step = max(1, (1 << 19) // max(1, len(second)))
                for at in range(0, len(first), step):
                    some = first[at : at + step]
                    i, j, far = keep(np.repeat(some, len(second)), np.tile(second, len(some)))
                    if nearest and len(i):
                        both = np.concatenate([i, j])
                        o = np.lexsort((np.concatenate([far, far]), both))
                        best = o[np.concatenate([[True], both[o[1:]] != both[o[:-1]]])]
                        best = np.unique(best[np.isin(both[best], some)] % len(i))
                        i, j = i[best], j[best]
                    found.append((i, j))
        if len(unit) > 10 * TOGETHER:
            K.trim()
        i, j = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 2
        a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
        pairs = np.unique(np.stack([a, b]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(K.views(batch.column("set_a")), K.views(batch.column("set_b")), strict=True):
                z = np.concatenate([x, y]).view(K.U)
                z.sort(kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                keep.append(100 * both >= percent * (len(z) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return K.lean(run)


def jaccard_components(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links).

    Words are runs of `[^\\x20\\x09-\\x0D]` after A-Z are lowered; a set is the distinct
    shingles of `words` words, or the whole sequence where it is shorter. Two
    documents link when 100 * intersection >= percent * union.

    Defined cases: null or empty texts, or texts without words, have no shingles and
    their own id; equal texts of at least one word link; rows that repeat an id are
    one node of the graph, each with a row; a null id has a null component unless its
    text is another document's; an empty table gives no rows; other columns are ignored.
    """
    ship(spark)
    ws = Workspace(spark, "jaccard")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    limit = f"a < b and least(na, nb) * 100 >= greatest(na, nb) * {percent}"

    sketched = ws.put(slim.mapInArrow(_classes(words, percent), "id long, n long, s1 long, s2 long, sketch binary"), "sketched")
    each = ws.put(sketched.drop("sketch"), "each")  # stays to the end, so without what is large in it
    full = each.where("n > 0")
    # A table, so that joins with it have two plain sides, of which a hot class can be split.
    reps = ws.put(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "reps")
    classes = ws.put(full.join(reps, ["s1", "s2", "n"]).select("id", "n", "rep"), "classes")

    shingles = full.agg(F.sum("n")).first()[0] or 0
    buckets = min(1 << 20, max(2 * partitions(spark), shingles // BUCKET_KEYS))
    shared = []
    for part in range(PASSES):
        keyed = slim.where("id is not null").mapInArrow(_keyed(words, percent, buckets, part, PASSES), "bucket int, ids binary, sigs binary, counts binary, keys binary")
        shared.append(ws.put(keyed.groupBy("bucket").applyInArrow(_shared_keys, "key long, id long, keys long"), f"shared{part}"))
        release(spark)
    by_rep = classes.select("id", "rep").distinct()
    member = ws.put(reduce(DataFrame.union, shared).join(by_rep, "id").groupBy("key", "rep").agg(F.sum("keys").alias("keys")), "member")
    look = ws.put(sketched.join(member.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "n", "sketch").dropDuplicates(["id"]), "look")
    ws.drop("classes", "sketched", *(f"shared{part}" for part in range(PASSES)))
    release(spark)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ids = ws.put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-ids")
        some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        sets = slim.join(some, "id", "left_semi").mapInArrow(_packed_sets(words), "id long, set binary")
        wide = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
        out = ws.put(wide.mapInArrow(_linked(percent), "a long, b long"), name)
        release(spark)
        return out

    # Each member of a key and the one that shares most keys.
    shares = member.groupBy("rep").agg(F.sum("keys").alias("keys"))
    hubs = member.drop("keys").join(shares, "rep").groupBy("key").agg(F.max(F.struct("keys", (-F.col("rep")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    star = member.join(hubs, "key").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    star = ws.put(star, "star")
    release(spark)
    wide = star.join(look.toDF("a", "na", "xa"), "a").join(look.toDF("b", "nb", "xb"), "b").where(limit)
    tried = ws.put(wide.mapInArrow(_near(percent), "a long, b long"), "tried")
    links = verified(tried, "links")
    label = ws.put(components(spark, ws, links), "label")

    def still(member: DataFrame, label: DataFrame, name: str) -> DataFrame:
        """Members of the keys that lie in two components or more, with their labels."""
        known = member.join(label.toDF("rep", "label"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
        mixed = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where("x < y").drop("y")
        mixed = ws.put(mixed.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")), f"{name}-keys")
        # units of one component lie together, in as many places as their rows need
        places = mixed.groupBy("x").agg(F.ceil(F.sum(F.col("c") * F.col("blocks")) / TOGETHER).alias("places"))
        mixed = mixed.join(places, "x").select("key", "blocks", "x", "places")
        out = ws.put(known.join(mixed, "key"), name)
        ws.drop(f"{name}-keys")
        release(spark)
        return out

    def apart(known: DataFrame, nearest: bool) -> DataFrame:
        """Pairs that share a key, lie in two components and are near by their sketches."""
        low, high = F.least("side", "other"), F.greatest("side", "other")
        dealt = (
            known.withColumn("side", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            # a unit is a block with itself (kind 0) or one (kind 1) with another (kind 2)
            .select("x", "places", "rep", "label", F.xxhash64("key", low, high).alias("unit"), F.when(low == high, 0).when(F.col("side") == low, 1).otherwise(2).alias("kind"))
            # so many groups that a partition has several, and no place is a large part of one
            .withColumn("bucket", F.pmod(F.xxhash64("x", F.pmod("unit", "places")), F.lit(8 * partitions(spark))).cast("int"))
        )
        # a set's sketch travels once to each bucket, with all its units there
        dealt = dealt.groupBy("bucket", "rep", "label").agg(F.collect_list(F.struct("unit", "kind")).alias("units"))
        dealt = dealt.join(look.select(F.col("id").alias("rep"), "n", "sketch"), "rep")
        return dealt.groupBy("bucket").applyInArrow(_apart(percent, nearest), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")

    for i in range(ROUNDS + 1):
        narrow = still(member.select("key", "rep") if i == 0 else narrow.select("key", "rep"), label, f"narrow{i}")
        ws.drop("member" if i == 0 else f"narrow{i - 1}")
        rest = ws.put(apart(narrow, i < ROUNDS), f"rest{i}")
        more = verified(rest, f"links{i}")
        tried, links = tried.union(rest), links.union(more)
        if more.limit(1).count():
            label = ws.put(components(spark, Workspace(spark, "jaccard"), links), f"label{i}")
    ws.drop("look", "star", "tried", f"narrow{ROUNDS}", *(f"rest{i}" for i in range(ROUNDS + 1)))

    final = each.join(reps, ["s1", "s2", "n"], "left").join(label.toDF("rep", "label"), "rep", "left")
    return final.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "id").alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, five words, 75 percent."""
    from ..sources.tables import table

    return jaccard_components(spark, table(spark, sf_dir, "documents"))
