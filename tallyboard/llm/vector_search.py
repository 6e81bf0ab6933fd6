"""Exact top-k inner-product search: a KD-tree per shard, best-first traversal with a propagated kth score."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import stored

LEAF = 128
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
HITS = "query_id long, vec_id long, score long"
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class KdTree:
    """Vectors in leaf order; node i has the tight box `low[i]..high[i]`, rows `begin[i]..end[i]` and two children or none."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # left child, -1 in a leaf; the right child follows it
    least_id: np.ndarray


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> KdTree:
    """Median splits on the dimension of largest spread, down to `leaf` rows."""
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    order = np.arange(len(ids))
    begin, end, child = [0], [len(ids)], [-1]
    low, high, least = [], [], []
    node = 0
    while node < len(begin):
        rows = order[begin[node] : end[node]]
        own = vectors[rows]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        least.append(ids[rows].min())
        spread = high[-1] - low[-1]
        if len(rows) > leaf and spread.any():
            half = len(rows) // 2
            order[begin[node] : end[node]] = rows[np.argpartition(own[:, int(np.argmax(spread))], half)]
            child[node] = len(begin)
            begin += [begin[node], begin[node] + half]
            end += [begin[node] + half, end[node]]
            child += [-1, -1]
        node += 1
    return KdTree(
        ids[order], vectors[order], np.array(low), np.array(high), np.array(begin), np.array(end), np.array(child), np.array(least)
    )


def search_tree(tree: KdTree, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> list:
    """Hits (query, vector, score) that may be among a query's k best.

    `kth` and `kth_id` are the score and id of the kth best known so far: a box is left out when its bound is below that
    score, or equals it and holds larger ids only. Arithmetic is exact in 64 bits.
    """
    exact = tree.vectors.shape[1] * float(np.abs(tree.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2**52
    kind = np.float64 if exact else np.int64
    vectors, points = tree.vectors.astype(kind), queries.astype(kind)
    bounds = np.maximum(points, 0) @ tree.high.T.astype(kind) + np.minimum(points, 0) @ tree.low.T.astype(kind)
    hits = []
    for row, query_id in enumerate(query_ids.tolist()):
        best: list[tuple[int, int]] = []  # (score, -id), the kth best on top
        limit, limit_id = int(kth[row]), int(kth_id[row])
        bound = bounds[row]
        frontier = [(-bound[0], 0)]
        while frontier:
            reach, node = heapq.heappop(frontier)
            if (-reach, -int(tree.least_id[node])) <= (limit, -limit_id):
                if -reach < limit:
                    break
                continue
            left = int(tree.child[node])
            if left >= 0:
                heapq.heappush(frontier, (-bound[left], left))
                heapq.heappush(frontier, (-bound[left + 1], left + 1))
                continue
            begin, end = tree.begin[node], tree.end[node]
            scores, ids = vectors[begin:end] @ points[row], tree.ids[begin:end]
            good = np.flatnonzero((scores >= limit) & (ids != query_id))
            if len(good) > k:
                good = good[np.lexsort((ids[good], -scores[good]))[:k]]
            for i in good.tolist():
                item = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and best[0] > (limit, -limit_id):
                limit, limit_id = best[0][0], -best[0][1]
        hits += [(query_id, -i, s) for s, i in best]
    return hits


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and floor(256 * x) per component, x as double.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. An id that repeats takes part
    with its smallest vector.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    whole = F.transform(x, lambda c: F.floor(c * F.lit(256.0)).cast("long"))
    return good.select(F.col("vec_id").cast("long"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in rows])


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One tree per shard, stored. Vectors of different lengths never meet: each length has its own shards."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(rows["vec_id"].to_numpy(), _matrix(rows["v"]))
        return pd.DataFrame({"width": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree, protocol=5)]})

    return stored(vectors.groupBy("width", "shard").applyInPandas(build, "width int, shard int, tree binary"), "kd-trees")


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The `k` best other rows for every row of `vectors` (vec_id, v) that `is_query` marks: query_id, rank, vec_id, score.

    First each query searches its own shard; the kth score found goes with it to all other shards. A task holds one tree and
    one block of queries. Ties go to the smaller id; a query with fewer than k candidates gets all.
    """
    vectors = stored(vectors.withColumn("width", F.size("v")), "vectors")
    shards = max(1, -(-vectors.count() // shard_rows))
    vectors = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = vectors.filter(is_query)
    blocks = max(1, -(-queries.count() // block_queries))
    index = build_index(vectors, shard_rows)

    def hits_of(trees: pd.DataFrame, rows: pd.DataFrame, kth: np.ndarray, kth_id: np.ndarray) -> list:
        tree = pickle.loads(trees["tree"].iloc[0])
        return search_tree(tree, rows["vec_id"].to_numpy(), _matrix(rows["v"]), k, kth, kth_id)

    def at_home(trees: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or trees.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        none = np.full(len(rows), np.iinfo(np.int64).min)
        found = hits_of(trees, rows, none, np.full(len(rows), NO_ID))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def abroad(trees: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or trees.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = hits_of(trees, rows, rows["kth"].to_numpy(), rows["kth_id"].to_numpy())
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    home = stored(
        queries.groupBy("width", "shard").cogroup(index.groupBy("width", "shard")).applyInPandas(lambda q, t: at_home(t, q), HITS), "home-hits"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    last = home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
    last = last.select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    known = queries.join(last, "vec_id", "left").select(
        "vec_id", "v", "width", F.col("shard").alias("own"), block.alias("block"),
        F.coalesce("kth", F.lit(np.iinfo(np.int64).min)).alias("kth"), F.coalesce("kth_id", F.lit(NO_ID)).alias("kth_id"),
    )
    sent = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard != own").drop("own")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("width", "shard", "block")
    away = sent.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(lambda q, t: abroad(t, q), HITS)
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for every vector whose id is divisible by 50, against all others."""
    return top_k(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
  GROUP BY 1
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5
"""
