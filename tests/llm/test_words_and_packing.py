"""Spelling variants, packing and collocations against brute-force versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, lang=lambda i: "en", source=lambda i: "s"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or "")) for i, t in texts], DOC)


# --- spelling variants ---------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants(texts, every=97, least=3):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= least and len(w) >= 5}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and edits(w, x) == 1] for w in n}
    form = {}
    for w, x in near.items():
        best = min(x, key=lambda y: (-n[y], y), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    return {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in df.collect()}


def scribble(r, words, n):
    out = []
    for w in r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n):
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            at, kind = r.randrange(len(w)), r.choice("idr")
            w = w[:at] + (r.choice("abeé×") if kind != "d" else "") + w[at + (kind != "i") :] or "x"
        out.append(w if r.random() < 0.8 else w.upper())
    return " ".join(out)


@pytest.mark.parametrize("block", [2000, 3])
def test_variants_against_brute_force(spark, monkeypatch, block):
    from tidewell.llm import spelling

    monkeypatch.setattr(spelling, "BLOCK", block)
    r = random.Random(block)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 9))) for _ in range(40)] + ["aaaaaa", "ananas", "bananas", "ÀÉÎÕÜ", "ßßßßß"]
    texts = [(i, scribble(r, words, 150)) for i in range(60)] + [(None, "ananas Ananas"), (61, None), (62, "")]
    got = rows(spelling.spelling_variants(spark, docs(spark, texts), every=7))
    assert got == variants(texts, 7)
    assert sum(x[4] for x in got) > 300 and any(x[2] != (x[1] or x[0]) for x in got)


def test_variants_ties_repeats_and_none(spark):
    from tidewell.llm.spelling import spelling_variants

    # two near words as frequent: the first in code-point order; a chain; a swap is no single edit
    texts = [(1, "house " * 3 + "mouse " * 8 + "louse " * 8 + "mouses " * 3 + "wolrd " * 3 + "world " * 9)] * 2 + [(2, "moused " * 30)]
    got = rows(spelling_variants(spark, docs(spark, texts), every=10**9))
    assert got == variants(texts, 10**9)
    assert {x[0]: x[1] for x in got}["house"] == "louse" and {x[0]: x[4] for x in got}["world"] == 0
    extra = docs(spark, texts).selectExpr("doc_id", "text", "1 as word", "2 as form", "3 as n")
    assert rows(spelling_variants(spark, extra, every=10**9)) == got
    assert spelling_variants(spark, docs(spark, [])).count() == 0
    assert spelling_variants(spark, docs(spark, [(1, "once upon"), (2, None)])).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(spark, docs(spark, []), min_chars=3)


def test_long_chains_and_one_hot_key(spark, monkeypatch):
    from tidewell.llm import spelling

    monkeypatch.setattr(spelling, "BLOCK", 16)
    chain = [("wordle" + "a" * k) for k in range(9)]
    # words that share their only rare bigram and all before it
    hot = [f"zq{a}{b}tion" for a in "abcdefghij" for b in "abcdefghij"]
    text = " ".join(" ".join([w] * (3 * 2**k)) for k, w in enumerate(chain)) + " " + " ".join(hot * 3)
    got = rows(spelling.spelling_variants(spark, docs(spark, [(1, text)]), every=10**9))
    assert got == variants([(1, text)], 10**9)
    assert {x[0]: x[2] for x in got}["wordle"] == chain[-1]


# --- collocations ----------------------------------------------------------------------------------


def brute_phrases(texts, lang, least=10, longest=3, top=2000):
    f, total = Counter(), Counter()
    for i, t in texts:
        name = lang(i) or "und"
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(FOLD)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[name] += len(w)
            for k in range(1, longest + 1):
                for j in range(len(w) - k + 1):
                    f[name, tuple(w[j : j + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inner = defaultdict(int)
    for (name, w), a in found.items():
        for k in range(2, len(w)):
            for j in range(len(w) - k + 1):
                inner[name, w[j : j + k]] = max(inner[name, w[j : j + k]], a)
    out = defaultdict(list)
    for (name, w), a in found.items():
        if 100 * inner[name, w] >= 50 * a:
            continue
        cuts = [(10**6 * a * a // (f[name, w[:k]] * f[name, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[name].append((-score, -a, " ".join(w).encode(), f[name, w[:k]], f[name, w[k:]]))
    return {
        (name, i, p.decode(), -a, le, ri, total[name], -s) for name, all_ in out.items() for i, (s, a, p, le, ri) in enumerate(sorted(all_)[:top], 1)
    }


def phrase_rows(df):
    return {(x.lang, x.rank, x.phrase, x.a, x.l, x.r, x.n, x.score) for x in df.collect()}


def chatter(r, n):
    w = "the of New York city. São Paulo, new york! a\tb  c\nd ÉTÉ x: ; ? e\x0bf g\rh".split(" ")
    return "".join(x + r.choice([" ", " ", "  ", "\t", ", ", ""]) for x in r.choices(w, weights=[1 / (k + 1) for k in range(len(w))], k=n))


@pytest.mark.parametrize(("cells", "most"), [(None, 1 << 30), (1, 1 << 30), (1 << 18, 1 << 16)])
def test_phrases_against_brute_force(spark, cells, most):
    """Also with a sketch so small that all collide, and with one in four slices."""
    from tidewell.llm.collocations import collocations

    r = random.Random(5)
    lang = lambda i: ["en", "de", None, "und", "ü"][(i or 0) % 5]
    texts = [(i, chatter(r, r.choice([0, 3, 40, 400]))) for i in range(90)] + [(91, None), (92, ""), (None, "new york " * 40)]
    got = phrase_rows(collocations(spark, docs(spark, texts, lang), cells=cells, most=most))
    want = brute_phrases(texts, lang)
    assert got == want and len(want) > 100
    assert phrase_rows(collocations(spark, docs(spark, texts, lang), top=7, cells=cells, most=most)) == brute_phrases(texts, lang, top=7)


def test_phrases_of_four_words_high_counts_and_none(spark):
    from tidewell.llm.collocations import collocations

    texts = [(i, "a b c d. b c d e " * 200) for i in range(5)] + [(9, "b c " * 900)]
    got = phrase_rows(collocations(spark, docs(spark, texts), least=400, longest=4))
    assert got == brute_phrases(texts, lambda i: "en", 400, 4)
    assert collocations(spark, docs(spark, [])).count() == 0
    assert collocations(spark, docs(spark, [(1, "a b"), (2, None)])).count() == 0
    extra = docs(spark, texts).selectExpr("text", "lang", "1 as phrase", "2 as n", "3 as rank")
    assert phrase_rows(collocations(spark, extra, least=400, longest=4)) == got


def test_scores_past_64_bits(spark):
    """The products of counts are 38-digit decimals; checked on the expression itself."""
    a, l, r = 10**14 - 3, 10**14 + 7, 10**14 + 11
    got = spark.sql(f"select (1000000 * (cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)))) div (cast({l} as decimal(16,0)) * cast({r} as decimal(16,0))) as s").first().s
    assert got == 10**6 * a * a // (l * r)


# --- packing -----------------------------------------------------------------------------------------


def packed(spark, frame, **given):
    import public_tokenizers as P

    from tidewell.llm.packing import pack_documents

    return pack_documents(spark, frame, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, **given)


def held(pieces, texts, window=1024):
    """The contract: every id in one piece, sequences gapless, padding none; returns tokens of each (sequence, document)."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            part = np.array(ids[i][at : at + p.length], dtype="<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[i]), zlib.crc32(part)) and p.length > 0
            at += p.length
        assert at == len(ids[i])
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes)))
    full = sum(map(len, ids.values())) // window
    assert sizes[:full] == [window] * full and all(x & (x - 1) == 0 for x in sizes[full:]) and len(set(sizes[full:])) == len(sizes[full:])
    return by_sequence


def test_packing_keeps_the_mixture_in_every_window(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["token", "window", "Übung", "日本", "42", "<|endoftext|>", "mix"]) for _ in range(n))
    texts = [(i, text(r.choice([1, 30, 300, 2500]))) for i in range(160)] + [(200, None), (201, "")]
    source = lambda i: [None, "a", "b", "b", "b", "c", "c", f"rare{i}"][i % 8]
    frame = docs(spark, texts, source=source).repartition(5)
    pieces = packed(spark, frame).collect()
    by_sequence = held(pieces, texts)
    tokens = Counter()
    for p in pieces:
        tokens[source(p.doc_id)] += p.length
    every, full = sum(tokens.values()), sum(tokens.values()) // 1024
    assert full > 100
    for s in ("a", "b", "c", None):
        handed = 0
        for w in range(full):
            own = sum(p.length for p in by_sequence[w] if source(p.doc_id) == s)
            handed += own
            assert abs(own - 1024 * tokens[s] / every) < 2 and abs(handed - 1024 * (w + 1) * tokens[s] / every) < 2


def test_packing_to_targets_and_blocks_of_partitions(spark, monkeypatch):
    from tidewell.llm import packing

    monkeypatch.setattr(packing, "BASES", 2)
    r = random.Random(4)
    texts = [(i, "word " * r.randint(0, 900)) for i in range(60)]
    source = lambda i: "abc"[i % 3]
    frame = docs(spark, texts, source=source).repartition(4)
    pieces = packed(spark, frame, targets={"a": 6, "b": 1}, window=256).collect()
    by_sequence = held(pieces, texts, 256)
    first = Counter(source(p.doc_id) for s in range(10) for p in by_sequence[s] for _ in range(p.length))
    assert first["c"] == 0 and abs(first["a"] - 2560 * 6 / 7) < 2
    ends = {s: max(p.sequence_id for p in pieces if source(p.doc_id) == s) for s in "abc"}
    assert ends["a"] < ends["b"] and min(p.sequence_id for p in pieces if source(p.doc_id) == "c") >= ends["b"]


def test_sequences_hold_the_ids(spark):
    from tidewell.llm.packing import packed_sequences

    texts = [(i, "some words of a text " * 30 * (i % 4)) for i in range(12)]
    pieces = packed(spark, docs(spark, texts, source=lambda i: str(i % 2)), with_ids=True)
    own = {(p.sequence_id, p.offset): p for p in pieces.collect()}
    for s in packed_sequences(pieces).collect():
        assert len(s.ids) == 4 * s.n
        for (q, at), p in own.items():
            if q == s.sequence_id:
                assert s.ids[4 * at : 4 * (at + p.length)] == p.ids and zlib.crc32(p.ids) == p.ids_crc32


def test_packing_repeats_nulls_names_and_none(spark):
    rows = [(None, "x y", 1), (5, None, 2), (5, None, 2), (5, "z", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").selectExpr("*", "cast(null as string) as source", "7 as `offset`", "8 as part")
    got = packed(spark, frame).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in got if p.start == 0) == [(0, 3), (5, 1), (5, 1), (5, 2)]
    assert sum(p.length for p in got) == 7 and sorted({p.sequence_id for p in got}) == [0, 1, 2]
    assert packed(spark, frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packed(spark, frame, window=1000)


@pytest.mark.parametrize("seed", range(6))
def test_stretches_deal_every_token_once(seed):
    """Any queues and targets: whole windows, no queue given more than it has, cuts that tile each queue."""
    from tidewell.llm.packing import _Plan, stretches

    r = random.Random(seed)
    tokens = [r.choice([0, 1, 3, 50, 700, 9000]) * r.randint(1, 9) for _ in range(r.randint(1, 40))]
    weights = [Fraction(t) for t in tokens] if seed % 2 else [Fraction(r.choice([0, 1, 2, 1000])) for _ in tokens]
    plan = stretches(tokens, weights, 64)
    assert [sum(s.gives[j] for s in plan) for j in range(len(tokens))] == tokens
    assert all(sum(s.gives) == s.n * s.size for s in plan) and len(plan) < 4 * len(tokens) + 12
    queue = np.array([j for j, t in enumerate(tokens) if t])
    size = np.array([tokens[j] for j in queue])
    if len(queue):
        doc, start, length, sequence, offset = _Plan(plan).cut(queue, np.zeros(len(queue), dtype=np.int64), size)
        assert length.sum() == size.sum()
        seen = defaultdict(list)
        for row in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
            seen[row[0]].append(row[1:])
        for own in seen.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at & (at - 1) == 0 and at <= 64


def test_products_of_long_stretches_stay_exact():
    from tidewell.llm.packing import STRETCH, _Plan, Stretch

    n = STRETCH
    gives = [341 * n + 5, 683 * n - 5]
    at = 340 * n + 12345
    doc, start, length, sequence, offset = _Plan([Stretch(0, n, 1024, [0, 0], gives)]).cut(np.array([0]), np.array([at]), np.array([1000]))
    assert length.sum() == 1000
    for s, x, o in zip(sequence.tolist(), start.tolist(), offset.tolist(), strict=True):
        assert s * gives[0] // n <= at + x < (s + 1) * gives[0] // n and o == at + x - s * gives[0] // n
