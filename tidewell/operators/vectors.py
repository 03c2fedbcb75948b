"""Vector operators: similarities by higher-order functions, and search by matrix blocks, exact or through an index.

Search never makes a row of a query and a vector: a task multiplies a block of queries with a
block of vectors and keeps the k best of each query; only those leave it. The index deals the
vectors to lists around trained centroids; a search reads the lists nearest to each query, and in
exact mode also every list whose bound still reaches the query's k-th best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.formats import scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that are broadcast; more are dealt with the rows.
BROADCAST_QUERIES = 20_000
#: Queries and vectors of one product at most, and its cells, so that a task's memory is bounded.
QUERY_BLOCK, ROW_BLOCK, CELLS = 4_096, 65_536, 1 << 19
#: Vectors that the index's centroids are trained on at most, and most lists.
TRAINING, LISTS = 50_000, 4_096
#: Similarities are told apart to so many digits; those equal in them go by id.
DIGITS = 6


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Best:
    """The k best vectors of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.empty((len(ids), 0), dtype=np.int64)
        self.found = np.empty((len(ids), 0), dtype=ids.dtype)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            own = ids[at : at + step]
            score = np.rint(self.queries @ rows[at : at + step].T * 10**DIGITS).astype(np.int64)
            order = np.sort(np.concatenate([self.found.ravel(), own]))
            order = order[np.append(True, order[1:] != order[:-1])]
            place = np.concatenate([np.searchsorted(order, self.found), np.broadcast_to(np.searchsorted(order, own), score.shape)], axis=1)
            every = np.concatenate([self.found, np.broadcast_to(own, score.shape)], axis=1)
            score = np.concatenate([self.score, score], axis=1)
            key = -score * len(order) + place  # larger scores first, then smaller ids: one whole number for both
            key[every == self.ids[:, None]] = np.iinfo(np.int64).max  # a query is not its own neighbour
            keep = np.argsort(key, axis=1, kind="stable")[:, : self.k] if key.shape[1] <= self.k else np.argpartition(key, self.k - 1, axis=1)[:, : self.k]
            self.score, self.found = np.take_along_axis(score, keep, 1), np.take_along_axis(every, keep, 1)

    def rows(self) -> pa.RecordBatch:
        ok = self.found != self.ids[:, None]
        q = np.broadcast_to(self.ids[:, None], self.found.shape)[ok]
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.found[ok]), pa.array(self.score[ok] / 10**DIGITS)], ["query_id", "vec_id", "similarity"])


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")


def _shape(rows: DataFrame) -> str:
    kind = rows.schema["vec_id"].dataType.simpleString()
    return f"query_id {kind}, vec_id {kind}, similarity double"


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k rows of largest dot product for each query: query_id, vec_id, similarity, place; (vec_id, embedding) on both sides.

    Similarities are rounded to six digits, ties go to the smaller id; a query is not its own
    neighbour. Ids are whole numbers, vectors all of one length; rows with a null in either are left out.

    Few queries, counted before, go to every task as a matrix, and no row is shuffled. More are dealt into
    blocks of about QUERY_BLOCK, rows into blocks of about ROW_BLOCK, and each pair of blocks meets in one group.
    """
    spark, queries, rows = rows.sparkSession, _plain(queries), _plain(rows)
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        own = queries.toArrow()
        held = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), matrix(own.column("embedding"))))

        def run(batches):
            ids, m = held.value
            best = [Best(ids[i : i + QUERY_BLOCK], m[i : i + QUERY_BLOCK], k) for i in range(0, len(ids), QUERY_BLOCK)]
            for batch in batches:
                for b in best if batch.num_rows else ():
                    b.add(batch.column(0).to_numpy(), matrix(batch.column(1)))
            for b in best:
                yield b.rows()

        return _first(rows.mapInArrow(run, _shape(rows)), k)
    query_blocks, row_blocks = -(-n // QUERY_BLOCK), -(-rows.count() // ROW_BLOCK)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a = queries.withColumn("q", deal("vec_id", query_blocks)).withColumn("r", every(max(1, row_blocks)))
    b = rows.withColumn("r", deal("vec_id", max(1, row_blocks))).withColumn("q", every(query_blocks))
    return _first(_met(a, b, ["q", "r"], k), k)


def _met(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each query in each group of equal keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(left.column("vec_id").to_numpy(), matrix(left.column("embedding")), k)
        if left.num_rows and right.num_rows:
            best.add(right.column("vec_id").to_numpy(), matrix(right.column("embedding")))
        return pa.Table.from_batches([best.rows()])

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, _shape(rows))


def train_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds over a sample; a centroid without members moves to a vector far from its own."""
    lists = max(1, min(lists, len(sample)))
    r = np.random.default_rng(seed)
    c = sample[np.sort(r.choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        at, far = assign(sample, c)
        n = np.bincount(at, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        c = total / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def assign(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row."""
    at, far = np.empty(len(rows), dtype=np.int64), np.empty(len(rows))
    half = (centroids**2).sum(1) / 2
    step = max(1, CELLS // len(centroids))
    for i in range(0, len(rows), step):
        score = rows[i : i + step] @ centroids.T - half
        at[i : i + step] = score.argmax(1)
        far[i : i + step] = np.maximum(0, (rows[i : i + step] ** 2).sum(1) - 2 * score.max(1))
    return at, far


class VectorIndex:
    """Inverted lists of vectors around centroids, as a table in the shared folder.

    `path` may name a folder that stays. Centroids come from at most TRAINING vectors (those of
    least hash); every vector is in the list of its nearest one. Of each list the size and radius are held.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/rows")
        lists = spark.read.parquet(f"{path}/lists").orderBy("list").toArrow()  # at most LISTS rows
        self.centroids, self.size, self.radius = matrix(lists.column("centroid")), lists.column("n").to_numpy(), lists.column("radius").to_numpy()

    @classmethod
    def build(cls, rows: DataFrame, lists: int | None = None, path: str | None = None) -> VectorIndex:
        """Index all rows of (vec_id, embedding); by default about the root of their number of lists."""
        spark, rows, path = rows.sparkSession, _plain(rows), path or scratch(rows.sparkSession)
        n = rows.count()
        lists = max(1, min(LISTS, lists or round(n**0.5)))
        share = min(1.0, 1.2 * TRAINING / max(1, n))
        some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAINING)
        sample = matrix(some.select("embedding").toArrow().column(0))
        centroids = train_centroids(sample, lists) if len(sample) else np.zeros((1, 0))

        def deal(batches):
            for batch in batches:
                at, far = assign(matrix(batch.column(1)), centroids) if batch.num_rows else (np.empty(0, dtype=np.int64), np.empty(0))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(np.sqrt(far))], ["vec_id", "embedding", "list", "far"])

        kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
        dealt = rows.mapInArrow(deal, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, list int, far double")
        # files hold ranges of lists, so a search of few lists reads few of them
        dealt.repartitionByRange("list", "vec_id").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/rows")
        found = {r.list: (r.n, r.far) for r in spark.read.parquet(f"{path}/rows").groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
        table = [(i, c.tolist(), *found.get(i, (0, 0.0))) for i, c in enumerate(centroids)]
        spark.createDataFrame(table, "list int, centroid array<double>, n long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        return cls(spark, path)

    def _probes(self, queries: DataFrame, probes: int, bound: DataFrame | None = None) -> DataFrame:
        """(vec_id, embedding, list): the `probes` best lists of each query; with a bound (query_id, kth), all others that may hold better ones."""
        c, radius, live, rest = self.centroids, self.radius, np.flatnonzero(self.size > 0), bound is not None

        def choose(batches):
            for batch in batches:
                m = matrix(batch.column(1))
                if not batch.num_rows or not len(live):
                    continue
                score = m @ c[live].T
                order = np.argsort(-score, axis=1, kind="stable")
                near = np.zeros(score.shape, dtype=bool)
                np.put_along_axis(near, order[:, :probes], True, 1)
                if rest:
                    # what a member can reach at most: its centroid's product and the radius times the query's length
                    most = score + radius[live] * np.linalg.norm(m, axis=1)[:, None]
                    near = ~near & (most >= batch.column(2).to_numpy(zero_copy_only=False)[:, None] - 10.0 ** (1 - DIGITS))
                q, at = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), pa.array(live[at].astype(np.int32))], ["vec_id", "embedding", "list"])

        if bound is not None:
            queries = queries.join(bound, queries["vec_id"] == bound["query_id"], "left").select("vec_id", "embedding", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
        kind = {x: queries.schema[x].dataType.simpleString() for x in ("vec_id", "embedding")}
        return queries.mapInArrow(choose, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, list int")

    def _searched(self, probed: DataFrame, k: int) -> DataFrame:
        """Queries meet the rows of their lists, both in blocks; long lists have many."""
        asked = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qs")).join(self._sizes(), "list")
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        asked = F.broadcast(asked)  # at most LISTS rows
        a = probed.join(asked, "list").withColumn("q", deal("vec_id", "qs")).withColumn("r", every("rs"))
        b = self.rows.select("list", "vec_id", "embedding").join(asked, "list").withColumn("r", deal("vec_id", "rs")).withColumn("q", every("qs"))
        return _met(a.select("list", "q", "r", "vec_id", "embedding"), b.select("list", "q", "r", "vec_id", "embedding"), ["list", "q", "r"], k)

    def _sizes(self) -> DataFrame:
        return self.spark.createDataFrame([(i, max(1, -(-int(n) // ROW_BLOCK))) for i, n in enumerate(self.size)], "list int, rs int")

    def nearest(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """As nearest(), over the `probes` lists nearest to each query; exact: the whole result, as without an index.

        The exact search takes the k-th best of the probed lists, which no result falls below, and
        searches every other list that may hold better ones.
        """
        queries = _plain(queries)
        found = _first(self._searched(self._probes(queries, probes), k), k)
        if not exact:
            return found
        at = scratch(self.spark)
        found.write.parquet(f"{at}/first")
        found = self.spark.read.schema(found.schema).parquet(f"{at}/first")
        kth = found.where(F.col("place") == k).select("query_id", F.col("similarity").alias("kth"))
        rest = self._searched(self._probes(queries, probes, kth), k)
        return _first(found.drop("place").unionByName(rest), k)
