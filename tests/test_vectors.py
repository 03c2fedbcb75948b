"""Vector search: exact against brute force, plans without pairs, the index's recall and exact mode."""

import numpy as np
import pytest

from tidewell.operators import vectors as V
from tidewell.plans.inspect import operators

SF = "/root/testdata/sf0.01"
SHAPE = "vec_id long, embedding array<float>"


def vectors(spark, m, ids=None):
    return spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids or range(len(m)), m.astype(np.float32), strict=True)], SHAPE)


def brute(m, queries, k):
    score = np.rint(m.astype(np.float32).astype(float)[queries] @ m.astype(np.float32).astype(float).T * 1e6)
    out = set()
    for q, s in zip(queries, score, strict=True):
        order = sorted((-s[i], i) for i in range(len(m)) if i != q)[:k]
        out |= {(q, i, -x / 1e6, n) for n, (x, i) in enumerate(order, 1)}
    return out


def got(df):
    return {(x.query_id, x.vec_id, x.similarity, x.place) for x in df.collect()}


def clustered(seed, n, d=16, clusters=30, ties=True):
    r = np.random.default_rng(seed)
    m = r.normal(size=(clusters, d))[r.integers(0, clusters, n)] + 0.4 * r.normal(size=(n, d))
    if ties:  # equal vectors, so that ids decide
        m[n // 2 : n // 2 + 20] = m[0]
    return m / np.linalg.norm(m, axis=1)[:, None]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "ROW_BLOCK", 90)
    monkeypatch.setattr(V, "CELLS", 300)


@pytest.mark.parametrize("broadcast", [20_000, 3])
def test_nearest_against_brute_force(spark, monkeypatch, small_blocks, broadcast):
    monkeypatch.setattr(V, "BROADCAST_QUERIES", broadcast)
    m = clustered(1, 400)
    d = vectors(spark, m).repartition(3)
    out = V.nearest(d.where("vec_id % 20 = 0"), d, 6)
    assert got(out) == brute(m, list(range(0, 400, 20)), 6)
    found = operators(out)
    assert not found["BroadcastNestedLoopJoin"] and not found["CartesianProduct"] and not found["Generate"] * (broadcast > 3)


def test_nulls_fewer_rows_than_asked_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (None, [1.0, 1.0]), (3, None)]
    d = spark.createDataFrame(rows, SHAPE)
    assert got(V.nearest(d, d, 5)) == {(1, 2, 0.5, 1), (2, 1, 0.5, 1)}
    assert got(V.VectorIndex.build(d).nearest(d, 5, probes=1, exact=True)) == {(1, 2, 0.5, 1), (2, 1, 0.5, 1)}
    none = d.limit(0)
    assert V.nearest(none, d, 5).count() == 0 and V.nearest(d, none, 5).count() == 0
    assert V.VectorIndex.build(none).nearest(d, 5, exact=True).count() == 0


def test_exact_mode_of_the_index(spark, small_blocks):
    """Few lists probed first; the bound brings in the rest that matter. Vectors of unequal length too."""
    m = clustered(2, 500) * np.linspace(0.2, 3, 500)[:, None]
    d = vectors(spark, m)
    index = V.VectorIndex.build(d, 25)
    q = d.where("vec_id % 20 = 0")
    want = brute(m, list(range(0, 500, 20)), 5)
    exact = index.nearest(q, 5, probes=1, exact=True)
    assert got(exact) == want
    assert not operators(exact)["BroadcastNestedLoopJoin"]
    assert len(got(index.nearest(q, 5, probes=1)) & want) < len(want)


def test_recall_on_embeddings_and_reopening(spark, tmp_path):
    from tidewell.sources.tables import table

    e = table(spark, SF, "embeddings")
    path = f"file://{tmp_path}/index"
    V.VectorIndex.build(e, path=path)
    index = V.VectorIndex(spark, path)
    assert index.size.sum() == e.count()
    q = e.where("vec_id % 20 = 0")
    pairs = lambda d: {(x.query_id, x.vec_id) for x in d.collect()}
    exact = pairs(V.nearest(q, e, 5))
    # vectors without clusters, where lists help least: four fifths of them are probed
    assert len(pairs(index.nearest(q, 5, probes=18)) & exact) >= 0.9 * len(exact)


def test_recall_on_clusters(spark):
    """Where vectors lie in clusters a tenth of the lists is enough."""
    m = clustered(6, 3000, d=24, clusters=60, ties=False)
    d = vectors(spark, m)
    index = V.VectorIndex.build(d, 60)
    q = d.where("vec_id % 20 = 0")
    want = {(a, b) for a, b, _, _ in brute(m, list(range(0, 3000, 20)), 10)}
    assert len({(x.query_id, x.vec_id) for x in index.nearest(q, 10, probes=6).collect()} & want) >= 0.9 * len(want)


def test_one_hot_list(spark, small_blocks):
    """Nearly all vectors in one list: it is searched in many groups."""
    r = np.random.default_rng(3)
    m = np.concatenate([np.full((600, 8), 0.5) + 1e-3 * r.normal(size=(600, 8)), r.normal(size=(12, 8))])
    d = vectors(spark, m)
    index = V.VectorIndex.build(d, 4)
    assert index.size.max() >= 500
    q = d.where("vec_id % 20 = 0")
    assert got(index.nearest(q, 3, probes=2, exact=True)) == brute(m, list(range(0, 612, 20)), 3)


def test_memory_of_a_block_of_queries_is_small():
    """A full block of queries against a batch: far less than all its cells at once."""
    import tracemalloc

    r = np.random.default_rng(9)
    best = V.Best(np.arange(V.QUERY_BLOCK), r.normal(size=(V.QUERY_BLOCK, 64)), 5)
    rows = r.normal(size=(2000, 64))
    tracemalloc.start()
    best.add(np.arange(2000) + 10_000, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
