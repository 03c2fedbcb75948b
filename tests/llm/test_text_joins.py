"""Jaccard join, decontamination and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOC)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= 75 * union:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(r, base, copies, edits):
    words = base.split()
    for _ in range(copies):
        w = list(words)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        yield " ".join(w)


def test_classes_that_share_half_a_digest_keep_their_keys(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidewell.llm import jaccard as J

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words, x]) for x in ("a", "b", "b")]
    digest = J.Sets.digest
    same_low = np.array([7, 7 + (1 << 40), 7 + (1 << 40)], dtype=np.int64)
    monkeypatch.setattr(J.Sets, "digest", lambda self: (same_low, digest(self)[1]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["id", "text"])
    keyed = pa.Table.from_batches(list(J._keyed(5, 75, 1)(iter([batch]))))
    shared = J._shared_keys([pa.scalar(0)], keyed)
    by_key = {}
    for k, i in zip(shared["key"].to_pylist(), shared["id"].to_pylist(), strict=True):
        by_key.setdefault(k, []).append(i)
    assert by_key and all(sorted(x) == [1, 2] for x in by_key.values())


def test_jaccard_against_all_pairs(spark):
    from tidewell.llm.jaccard import jaccard_components

    r = random.Random(4)
    texts = [None, "", "  \n", "one", "One", "a b c d", "a b c d", "a b c d e"]
    for n in (6, 9, 14, 25, 60, 150, 400):
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(n))
        texts += list(family(r, base, 14, max(2, n // 20)))
    common = " ".join(f"c{i}" for i in range(30))
    texts += [common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(1, 40))) for _ in range(40)]
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(spark, frame(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("n", [5, 12, 40, 80, 153, 154, 200, 300, 1200, 5000, 15502])
def test_pairs_on_the_very_limit_share_a_key(n):
    """Two sets as far apart as a link allows agree in a slice that both fill, in every band and for either size."""
    import numpy as np

    from tidewell.llm import jaccard as J

    r = np.random.default_rng(n)
    for _ in range(400 if n < 1000 else 40):
        m = r.integers(-(-n * 3 // 4), n, endpoint=True)
        both = -(-75 * (n + m) // 175)  # least intersection of sets of n and m shingles that link
        if both > m:
            continue
        h = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n + m - both).astype(np.uint64)
        s = object.__new__(J.Sets)
        s.n = np.array([n, m])
        s.at = np.array([0, n, n + m])
        s.hash = np.concatenate([np.sort(h[:n]), np.sort(h[n - both :])])
        d, k = J.all_keys(s, np.array([0, 1]), 75)
        assert set(k[d == 0].tolist()) & set(k[d == 1].tolist())


def test_jaccard_at_the_limit_in_wide_bands(spark):
    from tidewell.llm.jaccard import jaccard_components

    r = random.Random(12)
    texts = []
    for n in (200, 400, 900, 2000):
        for _ in range(12):
            w = [f"w{r.randrange(10**7)}" for _ in range(n)]
            edge = round(n / 7)  # about as many words replaced at the end as a link allows
            for more in (-1, 0, 1, 2):
                texts.append(" ".join(w))
                texts.append(" ".join([*w[: n - edge - more], *(f"x{r.randrange(10**7)}" for _ in range(edge + more))]))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(spark, frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_hot_keys_in_blocks(spark, monkeypatch):
    """A slice that a third of all sets share, more members than a block, and links among them."""
    from tidewell.llm import jaccard as J

    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "TOGETHER", 64)
    r = random.Random(13)
    common = " ".join(f"c{i}" for i in range(70))
    texts = [common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(20, 45))) for _ in range(150)]
    texts += [t.rsplit(" ", 2)[0] + " z z" for t in texts[:40]]
    texts += [" ".join(f"y{r.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(spark, frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_large_family_without_its_base(spark):
    from tidewell.llm.jaccard import jaccard_components

    r = random.Random(8)
    base = " ".join(f"w{i}" for i in range(120))
    rows = list(enumerate(list(family(r, base, 150, 7))))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(spark, frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_empty_table_repeats_and_null_ids(spark):
    from tidewell.llm.jaccard import jaccard_components

    assert jaccard_components(spark, frame(spark, [])).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "other words here now"), (1, "A b c d e f")]
    got = sorted((x.doc_id or -1, x.component_id or -1) for x in jaccard_components(spark, frame(spark, rows).withColumn("n_shingles", F.lit("clash"))).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (3, 1), (3, 1)]


def test_sketch_distance_bounds_difference():
    import numpy as np
    import pyarrow as pa

    from tidewell.llm import jaccard as J
    from tidewell.llm import kernels as K

    r = random.Random(1)
    a = [f"w{i}" for i in range(200)]
    texts = [" ".join(a)]
    for changes in (3, 8, 30, 120):
        b = list(a)
        for i in r.sample(range(200), changes):
            b[i] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(b[: 200 - changes // 4]))
    for _, _, w in K.words_of(pa.array(texts), K.SPACES, True):
        s = J.Sets(w, 5)
        sets = [set(s.hash[x:y].tolist()) for x, y in zip(s.at[:-1], s.at[1:], strict=True)]
        sketches = J.Sketches(pa.array(s.sketch(75), pa.binary()), s.n, 75)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
        near, share = sketches.near(i, j)
        for p, f in zip(near.tolist(), share.tolist(), strict=True):
            x, y = sets[i[p]], sets[j[p]]
            assert round(f * (len(x) + len(y))) <= len(x ^ y)
        out = set(range(len(i))) - set(near.tolist())
        assert out and all(4 * len(sets[i[p]] & sets[j[p]]) < 3 * len(sets[i[p]] | sets[j[p]]) for p in out)


def brute_contamination(texts, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(lower(t))
        if i is not None:
            for j in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    out = []
    for d, t in texts:
        w, found = pattern.findall(lower(t)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    found |= windows[k]
                    hit[j : j + n] = [1] * n
        out.append((d, len(w), sum(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination(spark, block):
    from tidewell.llm.decontamination import contamination

    r = random.Random(2)
    word = lambda: r.choice("alpha beta Gamma delta été 12 über eins two".split())
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(1, say(30)), (2, say(10)), (3, say(4)), (4, ""), (5, None), (None, say(12)), (6, "alpha"), (7, say(15))]
    items.append((8, items[0][1]))
    texts = []
    for i in range(60):
        inside = r.choice([t for _, t in items if t])
        texts.append((i, f"{say(r.randint(0, 50))}, {inside.upper() if i % 2 else inside}! {say(9)}"))
    texts += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(spark, frame(spark, texts), b, carry=["doc_id"], block_windows=block).collect()
    assert sorted(((x.doc_id, x.n_words, sum(s.end - s.start for s in x.spans), list(x.item_ids)) for x in got), key=str) == brute_contamination(texts, items)


@pytest.mark.parametrize("block", [200_000, 2])
def test_contamination_of_rows_that_share_an_id(spark, block):
    """Each row keeps its own hits, whatever blocks there are, and clashing columns stay."""
    from tidewell.llm.decontamination import contamination

    say = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    b = spark.createDataFrame([(1, say("a", 12)), (2, say("b", 12))], "item_id long, text string")
    rows = [(1, say("x", 12), "p"), (1, say("a", 12), "q"), (1, say("b", 12), "p"), (1, say("b", 12), "p"), (None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _text string").selectExpr("*", "_text as _row", "1 as _raw", "2 as spans")
    got = contamination(spark, d, b, block_windows=block).collect()
    assert sorted((x.doc_id or 0, x._text or "", x._raw, x.n_words, sum(s.end - s.start for s in x.spans), list(x.item_ids)) for x in got) == [
        (0, "", 1, 0, 0, []), (1, "p", 1, 12, 0, []), (1, "p", 1, 12, 12, ["2"]), (1, "p", 1, 12, 12, ["2"]), (1, "q", 1, 12, 12, ["1"])
    ]


def test_contamination_empty(spark):
    from tidewell.llm.decontamination import contamination

    b = spark.createDataFrame([], "item_id long, text string")
    got = contamination(spark, frame(spark, [(1, "a b")]), b).collect()
    assert [(x.doc_id, x.n_words, x.spans, x.item_ids) for x in got] == [(1, 2, [], [])]
    assert contamination(spark, frame(spark, []), b).count() == 0


def brute_substrings(texts, window):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        cut = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                cut[j : j + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (2, 2), (5, 2)])
def test_substring_dedup(spark, batches, fanout):
    from tidewell.llm.substrings import substring_dedup

    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    passages = [" ".join(word() for _ in range(n)) for n in (35, 36, 60, 34)]
    texts = [(i, " ".join([*(word() for _ in range(r.randint(0, 80))), r.choice(passages), *(word() for _ in range(r.randint(0, 60)))])) for i in range(50)]
    texts += [(90, None), (91, ""), (92, "a " * 200), (93, "x y " * 30), (94, passages[0]), (95, passages[3]), (96, texts[0][1]), (None, "solo " + passages[1])]
    texts += [(97, "la la la " * 5 + " ".join(word() for _ in range(100)))]
    got = substring_dedup(spark, frame(spark, texts), batches=batches, fanout=fanout, carry=["doc_id"]).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == brute_substrings(texts, 35)
    assert all(hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 for x in got)


def test_index_compacts(spark):
    from tidewell.llm._shared import Workspace
    from tidewell.llm.substrings import FingerprintIndex, _keyed

    index = FingerprintIndex(spark, f"{Workspace(spark, 'test').path}/index", window=35, fanout=2)
    text = " ".join(f"w{i}" for i in range(50))
    for i in range(4):
        found = index.add(_keyed(frame(spark, [(i, text)]), "doc_id", "text"))
        # a copy that is the only one of its run is given with the next; what runs merged before is not given again
        assert found.select("id").distinct().count() == (0, 2, 1, 2)[i]
    assert [len(x) for x in index.levels] == [0, 0, 1]
    index.remove()


def test_index_goes_on_in_another_session(spark):
    """Batches added by sessions that open the index again give what one batch gives; history is neither dealt nor sorted again."""
    from tidewell.llm._shared import Workspace
    from tidewell.llm.substrings import FingerprintIndex, _keyed, _sorted_buckets, _verified

    r = random.Random(15)
    passages = [" ".join(f"w{r.randrange(4000)}" for _ in range(n)) for n in (35, 50, 80)]
    fill = lambda: [f"v{r.randrange(9000)}" for _ in range(r.randint(0, 60))]
    texts = [(i, " ".join([*fill(), r.choice(passages), *fill()])) for i in range(45)] + [(99, None), (98, passages[2] + " " + passages[2])]
    ws = Workspace(spark, "test")
    docs = _keyed(frame(spark, texts), "doc_id", "text")

    def windows(suspects, name):
        rows = _verified(ws, docs, suspects, 35, name).collect()
        return {(x.id, x.lo + j) for x in rows for j in range(x.n)}

    one = FingerprintIndex(spark, f"{ws.path}/one")
    want = windows(one.add(docs), "w1")
    found = None
    for n in range(3):
        session = spark.newSession()
        index = FingerprintIndex(session, f"{ws.path}/more", window=35, fanout=3)
        assert index.state["version"] == n
        got = index.add(docs.where(F.pmod("id", F.lit(3)) == n))
        found = got if found is None else found.union(got)
        index.close()
    assert want and windows(found, "w2") == want
    index = FingerprintIndex(spark, f"{ws.path}/more")
    assert index.state["fanout"] == 3 and [len(x) for x in index.levels] == [0, 1]
    part = FingerprintIndex(spark, f"{ws.path}/part", fanout=9, buckets=3)
    part.add(docs.where("id > 0"))
    part.add(docs.where("id <= 0 and id % 2 = 0"))
    with _sorted_buckets(spark):
        for df in (part.met(*part.runs()), part.merged(*part.runs())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    for x in (one, index, part):
        x.remove()


def test_substrings_of_rows_that_share_an_id_and_clashing_names(spark):
    from tidewell.llm.substrings import substring_dedup

    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (None, b + " end", "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _text string").selectExpr("*", "_text as _id", "1 as _key", "2 as _RAW", "3 as n_words", "4 as `a b`")
    got = substring_dedup(spark, d).collect()
    assert sorted((x._text, x._id, x._key, x._RAW, x.n_words, x.n_removed, x.kept_text, x["a b"]) for x in got) == [("w", "w", 1, 2, 61, 60, "end", 4), ("x", "x", 1, 2, 60, 60, "", 4), ("y", "y", 1, 2, 60, 60, "", 4), ("z", "z", 1, 2, 60, 60, "", 4)]
    one = spark.createDataFrame([("k1", a), ("k2", a), ("k1", b)], "doc_id string, text string")
    assert sorted((x.doc_id, x.n_removed) for x in substring_dedup(spark, one).collect()) == [("k1", 0), ("k1", 60), ("k2", 60)]


def test_windows_of_one_half_hash_are_told_apart():
    import numpy as np

    from tidewell.llm.substrings import _grouped

    h = np.array([5, 5, 5, 7, 5], dtype=np.uint64)
    g = np.array([1, 2, 1, 1, 2], dtype=np.uint32)
    o, same = _grouped(h, g)
    assert sorted(zip(o[:-1][same].tolist(), o[1:][same].tolist(), strict=True)) == [(0, 2), (1, 4)]


def test_components_rounds_agree_with_one_task(spark, monkeypatch):
    from tidewell.llm import components as C
    from tidewell.llm._shared import Workspace

    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i + 1000, i + 1001) for i in range(60)]
    e = spark.createDataFrame(edges, "a long, b long").repartition(5)
    one = {(x.node, x.label) for x in C.components(spark, Workspace(spark, "t"), e).collect()}
    monkeypatch.setattr(C, "ONE_TASK", -1)
    assert {(x.node, x.label) for x in C.components(spark, Workspace(spark, "t"), e).collect()} == one


def test_keys_travel_in_five_bytes():
    import numpy as np
    import pyarrow as pa

    from tidewell.llm import jaccard

    text = " ".join(f"w{i}" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array([text, text + " more"])], ["id", "text"])
    out = pa.Table.from_batches(list(jaccard._keyed(5, 75, 4)(iter([batch]))))
    n = sum(int(np.frombuffer(c, dtype=np.uint32).sum()) for c in out.column("counts").to_pylist())
    assert n > 100 and sum(map(len, out.column("keys").to_pylist())) == 5 * n
    shared = pa.concat_tables([jaccard._shared_keys([pa.scalar(b)], out.filter(pa.compute.equal(out.column("bucket"), b))) for b in range(4)])
    assert set(shared.column("id").to_pylist()) == {7, 8}


def test_keys_of_the_same_members_are_one_in_all_buckets_and_passes():
    import numpy as np
    import pyarrow as pa

    from tidewell.llm import jaccard

    text = " ".join(f"w{i}" for i in range(400))
    rows = {7: text, 8: text + " more", -(2**62): text + " other end", 2**62: "something else altogether " * 9}
    batch = pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()))], ["id", "text"])

    def shared(parts):
        given, out = [], []
        for part in range(parts):
            got = pa.Table.from_batches(list(jaccard._keyed(5, 75, 4, part, parts)(iter([batch]))))
            given += got.column("bucket").to_pylist()
            out += [jaccard._shared_keys([pa.scalar(b)], got.filter(pa.compute.equal(got.column("bucket"), b))) for b in set(got.column("bucket").to_pylist())]
        assert len(given) == len(set(given)) == 4
        return pa.concat_tables(out).group_by(["key", "id"]).aggregate([("keys", "sum")]).to_pylist()

    once = shared(1)
    assert sorted(once, key=str) == sorted(shared(2), key=str)
    members = {}
    for x in once:
        members.setdefault(x["key"], set()).add(x["id"])
    # some hundred keys, no more than the sets of two and three of the three that are alike
    assert sum(x["keys_sum"] for x in once if x["id"] == 7) > 100 and len(members) <= 4
    assert len({frozenset(m) for m in members.values()}) == len(members) and set.union(*members.values()) == {7, 8, -(2**62)}
    for x in ([5], [1, 2, 3], [10, 5, 700], [2**62, -(2**62), 3], [-(2**63), 2**63 - 1], list(range(0, 10**7, 100_001))):
        assert jaccard._of_steps(jaccard._steps(np.array(x, dtype=np.int64))).tolist() == x
    assert len(jaccard._steps(np.arange(10**12, 10**12 + 1000))) == 1 + 8 + 999
