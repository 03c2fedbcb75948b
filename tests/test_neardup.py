"""Near duplicates by MinHash: components against all pairs, hot buckets, edges."""

import random

import pytest

from tidewell.operators import neardup as N


def sets(text, k=5):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(texts, similarity=0.75):
    s = {i: sets(t) for i, t in texts}
    root = {i: i for i in s}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    links = 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = s[a], s[b]
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                links += 1
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: (len(s[i]), min([j for j in ids if s[j] == s[i]] if s[i] else [i]), top(i)) for i in ids}, links


def found(spark, texts, **given):
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return {x.doc_id: (x.n_shingles, x.class_id, x.component_id) for x in N.near_duplicates(d, **given).collect()}


def prose(r, n):
    return [r.choice(["a", "be", "see", "dove", "eagle", "Fox", "goat", "hen", "ibis", "jay"]) + str(r.randrange(40)) for _ in range(n)]


def changed(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = "x" + str(r.randrange(1000))
    return w


@pytest.mark.parametrize(("stars", "block"), [(3, 128), (0, 6)])
def test_components_against_all_pairs(spark, monkeypatch, stars, block):
    """With hubs, and with blocks alone."""
    monkeypatch.setattr(N, "STARS", stars)
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(1)
    texts, i = [], 0
    for _ in range(25):
        base = prose(r, r.choice([3, 12, 80, 200]))
        for _ in range(r.choice([1, 1, 4, 12])):
            texts.append((i, " ".join(changed(r, base, r.choice([0, 0, 1, 2, len(base) // 40])))))
            i += 1
    texts += [(900, None), (901, ""), (902, " \n "), (903, "One TWO"), (904, "one two"), (905, "two one")]
    got, (want, links) = found(spark, texts), brute(texts)
    assert links > 100 and got == want


def test_chains_link_through_texts_between(spark):
    r = random.Random(2)
    base = prose(r, 120)
    chain = [base]
    for _ in range(9):
        chain.append(changed(r, chain[-1], 3))
    texts = [(i, " ".join(w)) for i, w in enumerate(chain)] + [(50 + i, " ".join(prose(r, 90))) for i in range(20)]
    got, (want, _) = found(spark, texts), brute(texts)
    assert got == want and not sets(texts[0][1]) & sets(texts[9][1]) or got[9][2] == 0


def test_one_group_of_many_near_copies(spark, monkeypatch):
    """A hot bucket: a few comparisons a member, with the hubs of its buckets, and no pairs of members."""
    r = random.Random(3)
    base = prose(r, 150)
    texts = [(i, " ".join(changed(r, base, 1))) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)]
    seen = []
    verified = N._verified

    def counted(pairs, sets, similarity):
        seen.append(pairs.count())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(N, "_verified", counted)
    got = found(spark, texts)
    assert {x[2] for x in got.values()} == {0} and {got[1000 + i][1] for i in range(300)} == {1000}
    assert sum(seen) < 8 * 401


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity lies just at 0.75 and above: all but few must be found."""
    r = random.Random(4)
    texts, want = [], 0
    for i in range(150):
        base = prose(r, 104)
        at = r.randrange(20, 80)
        other = base[:at] + ["new"] * 0 + ["q1", "q2", "q3"] + base[at + 3 :] if i % 2 else base[:at] + [f"z{j}" for j in range(10)] + base[at + 10 :]
        a, b = sets(" ".join(base)), sets(" ".join(other))
        want += len(a & b) >= 0.75 * len(a | b)
        texts += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = found(spark, texts)
    assert want >= 140 and sum(got[2 * i + 1][2] == 2 * i for i in range(150)) >= 0.97 * want


def test_repeated_and_null_ids_names_and_none(spark):
    rows = [(1, "a b c d e f g", 1), (1, "p q r s t u v", 2), (None, "A B C D E F G", 3), (None, None, 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "7 as digest", "8 as component_id")
    got = sorted((tuple(x) for x in N.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 3, 1, 1), (1, 3, 1, 1), (None, 3, 1, 1), (None, 0, None, None)], key=str)
    assert N.near_duplicates(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        N.near_duplicates(d, similarity=0.2)


def test_only_texts_that_meet_have_their_sets_written(spark, monkeypatch):
    """Two near texts among forty that share nothing: the sets of two rows travel, not of all."""
    seen, real = [], N._sets
    monkeypatch.setattr(N, "_sets", lambda d, words: seen.append(d.count()) or real(d, words))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)]
    rows += [(100, rows[3][1] + " more"), (101, rows[3][1]), (102, None)]
    got = {r.doc_id: (r.class_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen == [2]
    assert got[100] == (100, 3) and got[101] == (3, 3) and got[102] == (102, 102) and all(got[i] == (i, i) for i in range(40))
