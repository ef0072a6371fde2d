"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors are dealt by id into shards of about `SHARD_ROWS` rows, queries into blocks of at most about `BLOCK_ROWS`.  Where
a block meets a shard, the shard's ball tree is built and each query walks it best first: a node with centre c and
radius r holds no inner product above q.c + r|q|, and once that falls below the query's current kth score the walk ends.
The first round meets each query with its own shard only; the kth scores found there are the bounds that all other
shards start from.

Components are floor(scale * x), so scores are whole numbers and exact below 2**53.  Vectors that are null or empty, or
hold null or non-finite components, and rows without an id take no part; vectors of different lengths don't meet.  Equal
query rows count once; rows with the query's own id are no candidates.  Ties go to the smaller id.  An empty table gives
an empty result; extra columns take no part.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

LEAF = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
_FOUND = "query_no long, query_id long, vec_id long, score long"


class BallTree:
    """Nodes as flat arrays; the points of a node are a range of `order`."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.first, self.last, self.left, centres, radii = [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            here = points[self.order[a:b]]
            centre = here.mean(axis=0)
            away = np.sqrt(((here - centre) ** 2).sum(axis=1))
            node = len(self.first)
            if parent >= 0:
                self.left[parent].append(node)
            self.first.append(a)
            self.last.append(b)
            self.left.append([])
            centres.append(centre)
            radii.append(float(away.max()))
            if b - a > leaf and radii[-1] > 0:
                one = here[away.argmax()]
                other = here[((here - one) ** 2).sum(axis=1).argmax()]
                along = np.argsort(here @ (other - one), kind="stable")
                self.order[a:b] = self.order[a:b][along]
                middle = (a + b) // 2
                todo += [(a, middle, node), (middle, b, node)]
        self.points = points[self.order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int, bound: float) -> list[tuple[float, int]]:
        """Up to k (score, id) by falling score, then id, none below `bound`; `ids` are in the tree's order."""
        reach = self.centres @ query + self.radii * math.sqrt(float(query @ query))
        reach += 1 + 1e-9 * np.abs(reach)
        best: list[tuple[float, int]] = []  # a heap: the worst kept is first
        kth, heap = bound, [(-reach[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if self.left[node]:
                for child in self.left[node]:
                    if reach[child] >= kth:
                        heapq.heappush(heap, (-reach[child], child))
                continue
            a, b = self.first[node], self.last[node]
            scores = self.points[a:b] @ query
            for i in np.flatnonzero(scores >= kth):
                if ids[a + i] == own:
                    continue
                item = (float(scores[i]), -int(ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(table: pa.Table, scale: float) -> np.ndarray:
    lists = table.column("vector").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(table.num_rows, -1)


def _meet(k: int, scale: float):
    def meet(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], []]
        if queries.num_rows and shard.num_rows:
            tree = BallTree(_matrix(shard, scale))
            ids = shard.column("vec_id").to_numpy()[tree.order]
            rows = zip(queries.column("query_no").to_pylist(), queries.column("query_id").to_pylist(),
                       queries.column("bound").to_pylist(), _matrix(queries, scale))
            for no, own, bound, query in rows:
                for score, vec in tree.search(query, k, ids, own, -math.inf if bound is None else bound):
                    for column, value in zip(out, (no, own, vec, round(score))):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out],
                        names=["query_no", "query_id", "vec_id", "score"])
    return meet


def _searched(queries: DataFrame, vectors: DataFrame, k: int, scale: float) -> DataFrame:
    key = ["size", "shard", "block"]
    return queries.groupBy(*key).cogroup(vectors.groupBy(*key)).applyInArrow(_meet(k, scale), _FOUND)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose vec_id is divisible by `every`."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        "vec_id IS NOT NULL AND size(vector) > 0").where(finite)
    count = rows.agg(F.count(F.lit(1)).alias("n"),
                     F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    shards, blocks = max(1, math.ceil(count["n"] / SHARD_ROWS)), max(1, math.ceil(count["q"] / BLOCK_ROWS))
    rows = rows.withColumns({"size": F.size("vector"), "shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")})
    queries = stored(rows.where(F.col("vec_id") % every == 0).select(
        F.xxhash64("vec_id", "vector").alias("query_no"), F.col("vec_id").alias("query_id"), "vector", "size", "shard",
    ).dropDuplicates(["query_no", "query_id", "vector"]).withColumn(
        "block", F.pmod(F.xxhash64("query_no"), F.lit(blocks)).cast("int")), "queries")
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    home = stored(_searched(queries.withColumn("bound", F.lit(None).cast("double")), dealt, k, scale), "home")
    bounds = home.groupBy("query_no", "query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("bound"))
    away = queries.join(bounds, ["query_no", "query_id"], "left").withColumn("home", F.col("shard")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    found = home.unionByName(_searched(away.drop("home"), dealt, k, scale)) if shards > 1 else home
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
