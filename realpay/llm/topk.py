"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

A shard's vectors are split into nested balls. For a query q, no vector in a ball of centre c and radius r has
an inner product above q.c + |q| r. Nodes are visited in the order of that bound, and a node whose bound is
under the query's current k-th score is left out with all below it. A first round asks one shard only; each
later one asks MORE times as many as all before, and starts from the k-th score that these have found.
"""

from __future__ import annotations

import heapq
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from realpay.llm.tables import shuffle_partitions, stored

#: Vectors of a shard, about; it holds one tree in memory.
SHARD_ROWS = 16_384
#: Vectors of a shard at least, where there are fewer shards than shuffle partitions.
LEAST_ROWS = 4_096
#: Shards asked up to a round, against those asked before it.
MORE = 4
LEAF_ROWS = 64
#: Leaves whose products are computed at once.
LEAVES = 16
SCALE = 256
LONG = 2**63 - 1


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, x``: each component as floor(SCALE * component). Vectors that are null, empty or have a null or
    non-finite component are left out, and so are rows without id."""
    x = F.transform(vector_column, lambda v: v.cast("double"))
    fit = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), x.alias("x")).where("id is not null and size(x) > 0").where(fit)
    return rows.select("id", F.transform("x", lambda v: F.floor(v * SCALE).cast("double")).alias("x"))


class BallTree:
    """Balls over the rows of ``x``; ``order`` lists the rows so that each ball is a slice of it."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.order = x, ids, np.arange(len(x))
        self.centre, self.radius, self.least_id, self.slices, self.children = [], [], [], [], []
        self._ball(0, len(x))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.x, self.ids = x[self.order], ids[self.order]

    def _ball(self, low: int, high: int) -> int:
        rows = self.x[self.order[low:high]]
        centre = rows.mean(axis=0)
        distance = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(distance.max())
        self.least_id.append(self.ids[self.order[low:high]].min())
        self.slices.append((low, high))
        self.children.append(())
        if high - low > LEAF_ROWS:
            # between the row that is farthest from the centre and the one farthest from that
            a = rows[distance.argmax()]
            b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
            along = rows @ (b - a)
            middle = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(along, middle)]
            self.children[node] = (self._ball(low, low + middle), self._ball(low + middle, high))
        return node

    def search(self, query: np.ndarray, own_id, k: int, floor: float) -> list[tuple[int, int]]:
        """The ``k`` best (score, -id) of the shard, of those not under ``floor``; not ``own_id``."""
        length = float(np.sqrt(query @ query))
        bounds = self.centre @ query + length * self.radius
        bounds += 1e-9 * (np.abs(bounds) + length * (self.radius + np.sqrt((self.centre**2).sum(axis=1)))) + 1e-6  # rounding
        best: list[tuple[int, int]] = []  # the k best so far, the best first
        nodes = [(-bounds[0], 0)]
        while nodes:
            least = best[-1] if len(best) == k else (floor, -np.inf)
            leaves = []
            while nodes and len(leaves) < LEAVES:
                bound, node = heapq.heappop(nodes)
                if -bound < least[0]:
                    nodes = []
                elif len(best) == k and -bound < least[0] + 1 and -self.least_id[node] < least[1]:
                    continue  # at most a tie, and ties go to the smaller id
                elif self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(nodes, (-bounds[child], child))
                else:
                    leaves.append(slice(*self.slices[node]))
            if leaves:
                scores = _products(np.concatenate([self.x[s] for s in leaves]), query)
                ids = np.concatenate([self.ids[s] for s in leaves])
                good = (scores >= least[0]) & (ids != own_id)
                best = heapq.nlargest(k, best + list(zip(scores[good].tolist(), (-ids[good]).tolist())))
        return best


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where no partial sum can pass 2**53."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if most < 2.0**53:
        return (rows @ query).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows.tolist()], dtype=object)


def _search(batches, k: int):
    """The rows of one shard: the vectors of a length first, then the queries of that length."""
    width, ids, vectors, tree = None, [], [], None
    for batch in batches:
        x, is_query, own_ids = batch.column("x"), batch.column("is_query").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
        floors, at, flat = pc.fill_null(batch.column("floor"), -np.inf).to_numpy(), x.offsets.to_numpy(), x.values.to_numpy()
        sizes, out = np.diff(at), []
        cuts = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
        for low, high in pairwise([0, *cuts.tolist(), len(batch)] if len(batch) else []):
            rows = flat[at[low] : at[high]].reshape(high - low, sizes[low])
            if sizes[low] != width:
                width, ids, vectors, tree = sizes[low], [], [], None
            if not is_query[low]:
                ids.append(own_ids[low:high])
                vectors.append(rows)
                continue
            if tree is None and vectors:
                tree = BallTree(np.concatenate(vectors), np.concatenate(ids))
                vectors = []
            if tree is not None:
                for i, query, floor in zip(own_ids[low:high].tolist(), rows, floors[low:high].tolist()):
                    out += [(i, -j, min(max(score, -LONG), LONG)) for score, j in tree.search(query, i, k, floor)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])


def _asked(vectors: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """The best of each shard for each query that is put to it; a shard is a partition."""
    rows = vectors.select("shard", F.lit(False).alias("is_query"), "id", "x", F.lit(None).cast("double").alias("floor")).unionByName(
        queries.select("shard", F.lit(True).alias("is_query"), "id", "x", "floor"))
    rows = rows.withColumn("width", F.size("x")).repartitionById(shards, "shard").sortWithinPartitions("width", "is_query").drop("shard", "width")
    return rows.mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, its ``k`` best among all other ids.

    Scores are inner products of the whole vectors (:func:`whole_vectors`); ties go to the smaller id. A query
    and the vectors it is compared with have the same number of components. Scores and components beyond a
    long are cut to its limits. Fewer than ``k`` others: all of
    them. A row that repeats an id is a candidate each time, and an id that repeats among the queries is one
    query for each different vector. Other columns are ignored; an empty table gives an empty result.

    Rows go to shards of about SHARD_ROWS by hash, a partition each. Queries are a stated set and go to every
    shard: in the first round to one of them, by hash of their id, then to the next MORE - 1, and so on, with the
    k-th score of all rounds before as a floor.
    """
    whole = whole_vectors(vectors.withColumn("_q", is_query).withColumn("_id", F.struct(F.col(id_column).alias("id"), F.col("_q").alias("q"))), "_id", vector_column)
    whole = stored(whole.select("id.id", F.coalesce("id.q", F.lit(False)).alias("q"), "x").where("id is not null"), "vectors")
    n = whole.count()
    shards = max(1, round(n / SHARD_ROWS), min(shuffle_partitions(whole.sparkSession), n // LEAST_ROWS))
    dealt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int")
    put = whole.select("id", "x", dealt("id").alias("shard"))
    queries = stored(whole.where("q").select("id", "x").distinct().withColumn("home", dealt("id", F.lit(1))), "queries")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, low, high = None, 0, 1
    while low < shards:
        asks = queries.withColumn("step", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        asks = asks.withColumn("shard", F.pmod(F.col("home") + F.col("step"), F.lit(shards)))
        if best is None:
            found = _asked(put, asks.withColumn("floor", F.lit(None).cast("double")), k, shards)
        else:
            floors = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
            found = _asked(put, asks.join(floors, "id", "left"), k, shards).unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "best")
        low, high = high, min(high * MORE, shards)
    return best.select("query_id", "rank", "vec_id", "score")
