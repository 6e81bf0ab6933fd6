"""Ranked lexical search: exact top-k inner products of sparse vectors by ball trees.

Documents become sparse integer vectors over the terms of the queries. Every shard of them is a ball tree: a node has the
centroid of its documents and the radius of the ball around it that holds them, which bounds every score below it. The bound is
rounded up for all float errors, so what it prunes cannot be among the best; scores at the leaves are exact integers.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import batches_by_size, stored

BLOCK_BYTES = 1 << 20  # query text searched at once; more queries are searched in several blocks
GROUP_QUERIES = 256  # queries whose bounds are worked out together
TEXT_BYTES = 4 << 20  # text cut into terms at once; a longer text stands alone
LEAF = 32
SHARD_ROWS = 2048
SHARD_ENTRIES = 1 << 20
PROBED_FILES = 16  # files of trees searched first, for the scores that all others must reach
BOUND_CELLS = 1 << 20  # cells of the matrix of centroids that bounds are worked out from at once
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, which comes last among equal scores
HITS = "item int, item_id long, doc_id long, score long"
# Of a UTF-8 byte: a letter lower-cased, a digit or a byte of a longer character itself, all others a space.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if isinstance(text, str) else []


class Queries(NamedTuple):
    """Items with their terms as places in a vocabulary, and the number of times each occurs."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def read_queries(rows: list[tuple[int | None, str | None]]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    ids, terms, counts = [], [], []
    for item_id, text in rows:
        found = Counter(terms_of(text))
        if found:
            ids.append(item_id)
            terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in found]))
            counts.append(np.array(list(found.values())))
    return Queries(ids, vocabulary, terms, counts)


def term_vectors(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, n (all terms of the text) and, for those of the vocabulary, terms and their occurrences tf."""

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = vocabulary.value.get
        width = len(vocabulary.value) + 1
        for part in parts:
            texts = part["text"].tolist()
            for block in batches_by_size([len(t) if isinstance(t, str) else 0 for t in texts], TEXT_BYTES):
                words = [terms_of(texts[i]) for i in block]
                n = np.array([len(w) for w in words])
                found = np.fromiter((place(w, -1) for own in words for w in own), np.int64, n.sum())
                key, tf = np.unique((np.repeat(np.arange(len(n)), n) * width + found)[found >= 0], return_counts=True)
                cut = np.searchsorted(key, np.arange(1, len(n)) * width)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].iloc[block.start : block.stop].reset_index(drop=True), "n": n,
                    "terms": np.split((key % width).astype(np.int32), cut), "tf": np.split(tf.astype(np.int32), cut),
                })

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInPandas(vectors, "doc_id long, n long, terms array<int>, tf array<int>")


class Tree(NamedTuple):
    """Documents in leaf order, `start` cutting `terms` and `values` into theirs; node i has the documents `begin[i]..end[i]`,
    two children from `child[i]` on or none (-1), and a ball: sparse centroid and radius, in scaled space."""

    ids: np.ndarray
    start: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    centroid_start: np.ndarray
    centroid_terms: np.ndarray
    centroid_values: np.ndarray


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each pair of start and size."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def build_tree(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray, leaf: int = LEAF) -> Tree:
    """Splits at the median between two far documents, down to `leaf` documents or to equal ones.

    Every document has at least one term, every value is below a million. `scale` is the weight of each term's axis in the geometry of the balls.
    """
    start = np.cumsum(sizes) - sizes
    scaled = values * scale[terms]
    square = np.add.reduceat(scaled * scaled, start)
    slip = (2 * int(sizes.max()) + 64) * 2.0**-52  # share that rounding can take of a squared distance
    order = np.arange(len(ids))
    begin, end, child, radius, centroids = [0], [len(ids)], [-1], [], []
    node = 0
    while node < len(begin):
        rows = order[begin[node] : end[node]]
        own, at = sizes[rows], _ranges(start[rows], sizes[rows])
        t, y, offset = terms[at], scaled[at], np.cumsum(own) - own
        middle = np.bincount(t, weights=y, minlength=len(scale)) / len(rows)
        kept = np.flatnonzero(middle)
        centroids.append((kept.astype(np.int32), middle[kept].astype(np.float32)))
        middle[kept] = centroids[-1][1]

        def apart(point: np.ndarray, t=t, y=y, offset=offset, rows=rows) -> np.ndarray:
            """Squared distances, at least the true ones."""
            here = float(point @ point)
            return np.maximum(square[rows] - 2 * np.add.reduceat(y * point[t], offset) + here, 0) + 4 * slip * (square[rows] + here)

        far = apart(middle)
        radius.append(math.sqrt(far.max()) * (1 + 2.0**-40))
        if len(rows) > leaf:
            a = np.zeros(len(scale))
            i = int(np.argmax(far))
            a[t[offset[i] : offset[i] + own[i]]] = y[offset[i] : offset[i] + own[i]]
            away = apart(a)
            j = int(np.argmax(away))
            if away[j] > 16 * slip * (square[rows[i]] + square[rows[j]]):
                a[t[offset[j] : offset[j] + own[j]]] -= y[offset[j] : offset[j] + own[j]]
                half = len(rows) // 2
                order[begin[node] : end[node]] = rows[np.argpartition(np.add.reduceat(y * a[t], offset), half)]
                child[node] = len(begin)
                begin += [begin[node], begin[node] + half]
                end += [begin[node] + half, end[node]]
                child += [-1, -1]
        node += 1
    at = _ranges(start[order], sizes[order])
    small = np.uint16 if len(scale) <= 1 << 16 else np.int32
    return Tree(
        ids[order], np.concatenate([[0], np.cumsum(sizes[order])]), terms[at].astype(small), values[at].astype(np.int32), np.array(begin), np.array(end), np.array(child),
        np.array(radius), np.cumsum([0, *(len(c[0]) for c in centroids)]), *(np.concatenate(x) for x in zip(*centroids)),
    )


class Weights(NamedTuple):
    """What scores depend on besides a document: documents, all their terms, and the weight of each term."""

    documents: int
    terms: int
    weight: np.ndarray  # of each term of the vocabulary

    @property
    def scale(self) -> np.ndarray:
        return np.sqrt(self.weight.astype(np.float64))


def term_weights(documents: int, terms: int, df: np.ndarray) -> Weights:
    return Weights(documents, terms, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in df], dtype=np.int64))


def _values(n: np.ndarray, sizes: np.ndarray, tf: np.ndarray, weights: Weights) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 8 m), exact also where 75 n N leaves 64 bits."""
    m = np.array([25 + 75 * int(x) * weights.documents // weights.terms for x in n], dtype=np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))


def build_index(vectors: DataFrame, weights: Broadcast, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """tree: the ball trees, each of consecutive rows of one task. Documents without a term of any query are in none."""

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        entries = 0

        def tree() -> pd.DataFrame:
            ids, n, terms, tf = zip(*rows)
            sizes = np.array([len(t) for t in terms])
            values = _values(np.array(n), sizes, np.concatenate(tf), weights.value)
            blob = pickle.dumps(build_tree(np.array(ids), sizes, np.concatenate(terms), values, weights.value.scale), protocol=5)
            return pd.DataFrame({"tree": [blob]})

        for part in parts:
            ids = [NO_ID if pd.isna(i) else int(i) for i in part["doc_id"]]
            for row in zip(ids, part["n"], part["terms"], part["tf"]):
                if len(row[2]):
                    rows.append(row)
                    entries += len(row[2])
                    if len(rows) >= shard_rows or entries >= SHARD_ENTRIES:
                        yield tree()
                        rows, entries = [], 0
        if rows:
            yield tree()

    return vectors.mapInPandas(build, "tree binary")


class Best:
    """The k best (score, -id) of a query so far, and what a further document must exceed."""

    def __init__(self, k: int, floor: tuple[int, int]):
        self.k, self.floor, self.heap = k, floor, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= max(1, self.floor[0]))
        if len(good) > self.k:
            good = good[np.lexsort((ids[good], -scores[good]))[: self.k]]
        for score, i in zip(scores[good].tolist(), ids[good].tolist()):
            if (score, -i) < self.floor:
                continue
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -i))
            else:
                heapq.heappushpop(self.heap, (score, -i))
            if len(self.heap) == self.k:
                self.floor = max(self.floor, self.heap[0])


class Group:
    """Some queries with what their bounds and scores need."""

    def __init__(self, queries: Queries, members: range, weights: Weights):
        scale = weights.scale
        self.members = members
        self.terms = [queries.terms[i] for i in members]
        self.weights = [queries.counts[i] * weights.weight[queries.terms[i]] for i in members]
        self.columns = np.unique(np.concatenate(self.terms))
        self.column_of = np.full(len(scale), -1)
        self.column_of[self.columns] = np.arange(len(self.columns))
        self.matrix = np.zeros((len(self.columns), len(members)))
        for k, i in enumerate(members):
            self.matrix[self.column_of[queries.terms[i]], k] = queries.counts[i] * scale[queries.terms[i]]
        self.squares = self.matrix**2
        self.dense = np.zeros(len(scale), dtype=np.int64)

    def bounds(self, tree: Tree) -> np.ndarray:
        """For each node and query, no less than the score of any document below: the product with the centroid, plus the
        radius times the norm of the query's terms that the node has."""
        nodes = len(tree.radius)
        out = np.empty((nodes, len(self.members)))
        step = max(1, BOUND_CELLS // len(self.columns))
        for lo in range(0, nodes, step):
            hi = min(nodes, lo + step)
            own = slice(tree.centroid_start[lo], tree.centroid_start[hi])
            column = self.column_of[tree.centroid_terms[own]]
            row = np.repeat(np.arange(hi - lo), np.diff(tree.centroid_start[lo : hi + 1]))
            centres = np.zeros((hi - lo, len(self.columns)))
            centres[row[column >= 0], column[column >= 0]] = tree.centroid_values[own][column >= 0]
            norms = np.sqrt((centres > 0) @ self.squares)
            out[lo:hi] = centres @ self.matrix + tree.radius[lo:hi, None] * norms
        return out * (1 + (len(self.columns) + 64) * 2.0**-50) + 1e-6

    def search(self, tree: Tree, best: list[Best]) -> int:
        """Best-first through one tree for every query; the number of documents scored."""
        bounds = self.bounds(tree)
        scored = 0
        for k, i in enumerate(self.members):
            found, bound = best[i], bounds[:, k]
            self.dense[self.terms[k]] = self.weights[k]
            frontier = [(-bound[0], 0)]
            while frontier:
                reach, node = heapq.heappop(frontier)
                if -reach < max(1, found.floor[0]):
                    break
                left = int(tree.child[node])
                if left >= 0:
                    heapq.heappush(frontier, (-bound[left], left))
                    heapq.heappush(frontier, (-bound[left + 1], left + 1))
                    continue
                begin, end = tree.begin[node], tree.end[node]
                cut = tree.start[begin : end + 1]
                own = slice(cut[0], cut[-1])
                scores = np.add.reduceat(tree.values[own] * self.dense[tree.terms[own]], cut[:-1] - cut[0])
                found.offer(scores, tree.ids[begin:end])
                scored += int(end - begin)
            self.dense[self.terms[k]] = 0
        return scored


def _searched(trees: DataFrame, queries: Broadcast, weights: Broadcast, floors: Broadcast, k: int) -> DataFrame:
    """A task's k best documents of every query; what its first trees yield prunes the later ones."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = [Best(k, floor) for floor in floors.value]
        groups = [
            Group(asked, range(i, min(i + GROUP_QUERIES, len(asked.ids))), weights.value) for i in range(0, len(asked.ids), GROUP_QUERIES)
        ]
        for batch in batches:
            for blob in batch.column("tree"):
                tree = pickle.loads(blob.as_buffer())
                for group in groups:
                    group.search(tree, best)
        rows = [(i, asked.ids[i], None if d == -NO_ID else -d, s) for i, found in enumerate(best) for s, d in found.heap]
        columns = list(zip(*rows)) or [()] * 4
        kinds = {"item": pa.int32(), "item_id": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return trees.mapInArrow(search, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, queries: Queries, k: int, shard_rows: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    vectors = stored(term_vectors(docs, context.broadcast(queries.vocabulary)), "term-vectors")
    documents, terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(queries.vocabulary), dtype=np.int64)
    holding = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # at most the vocabulary
    df[holding["term"].to_numpy(np.int64)] = holding["count"].to_numpy(np.int64)
    weights = context.broadcast(term_weights(documents, terms, df))
    shared = context.broadcast(queries)
    files = sorted(stored(build_index(vectors, weights, shard_rows), "ball-trees").inputFiles())
    first = files[:: max(1, len(files) // PROBED_FILES)]
    others = sorted(set(files) - set(first))
    floors = [(0, 0)] * len(queries.ids)

    def trees(paths: list[str]) -> DataFrame:
        return docs.sparkSession.read.schema("tree binary").parquet(*paths)

    near = stored(_ranked(_searched(trees(first), shared, weights, context.broadcast(floors), k), k), "first-hits")
    if not others:
        return near
    for row in near.filter(F.col("rank") == k).collect():  # at most one row a query
        floors[row["item"]] = (row["score"], -NO_ID if row["doc_id"] is None else -row["doc_id"])
    rest = _searched(trees(others), shared, weights, context.broadcast(floors), k)
    return _ranked(near.drop("rank").unionByName(rest), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the `k` documents of highest positive score for every item.

    Equal scores go by doc_id, null ids last. Null texts and such without a term are no documents and no items; texts are
    read whole, every row of `docs` is a document, rows of `items` that repeat count once. Only the vocabulary of the items, in
    blocks of `block_bytes` of their text, reaches the driver; documents are read once a block, and a task holds one tree at
    a time. Empty tables give an empty result.
    """
    asked = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct(), "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for i in range(blocks):
        queries = read_queries([tuple(r) for r in asked.filter(block == i).orderBy("item_id", "text").collect()])
        if queries.ids:
            found.append(_search_block(docs, queries, k, shard_rows).select("item_id", "rank", "doc_id", "score"))
            if blocks > 1:
                found[-1] = stored(found[-1], "hits")
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents
), words AS (SELECT row, {TERMS} AS term FROM docs
), counted AS (SELECT row, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY ALL
), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, total GROUP BY term
), asked AS (
  SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, {TERMS} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
), scored AS (
  SELECT item_id, a.text, c.row,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::BIGINT AS score
  FROM asked a JOIN counted c USING (term) JOIN weights USING (term) JOIN lengths USING (row), total GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, s.text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scored s JOIN docs USING (row) WHERE score > 0
QUALIFY rank <= 10
"""
