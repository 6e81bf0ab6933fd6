"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import mix64

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 24  # of 64 bits; sets at the similarity bound lie at about 11 bits, with a deviation of 3
BLOCKS = 8
PART_BYTES = 16 << 20  # benchmark text in one broadcast; a larger benchmark is searched part by part
MATCHES = "array<struct<item_id: long, similarity: double, start_word: int, n_words: int>>"
DISTANCE = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class ItemIndex:
    """Items of at least `SHINGLE` words: their words, shingles, fingerprints and Hamming blocks."""

    item_ids: list[int]
    vocabulary: dict[str, int]
    shingles: np.ndarray  # sorted codes of all items
    sizes: np.ndarray  # shingles per item
    counts: list[Counter]
    fingerprints: np.ndarray
    near: np.ndarray  # block x value x item: the item's block lies within the block radius of the value


def _codes(words: np.ndarray) -> np.ndarray:
    """A 64-bit code per run of `SHINGLE` word numbers."""
    code = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        code = code * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - SHINGLE + 1 + k].astype(np.uint64)
    return mix64(code)


def _fingerprints(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows codes[s : s + size]: a bit is set where most of the shingles, with repeats, have it."""
    bits = ((codes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32)
    sums = np.vstack((np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    most = 2 * (sums[starts + size] - sums[starts]) > size
    return (most.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _bytes_of(fingerprints: np.ndarray) -> np.ndarray:
    return fingerprints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)


def index_items(items: list[tuple[int, str]], radius: int = RADIUS) -> ItemIndex:
    vocabulary: dict[str, int] = {}
    ids, codes = [], []
    for item_id, text in items:
        words = WORD.findall(text.lower())
        if len(words) >= SHINGLE:
            ids.append(item_id)
            codes.append(_codes(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])))
    prints = np.array([_fingerprints(c, np.array([0]), len(c))[0] for c in codes], dtype=np.uint64)
    gaps = DISTANCE[np.arange(256, dtype=np.uint8)[None, :, None] ^ _bytes_of(prints).T[:, None, :]]
    every = np.unique(np.concatenate(codes)) if codes else np.empty(0, dtype=np.uint64)
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    return ItemIndex(ids, vocabulary, every, sizes, [Counter(c.tolist()) for c in codes], prints, gaps <= radius // BLOCKS)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared over united weight of two multisets of shingles."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def match_text(text: str | None, index: ItemIndex, radius: int = RADIUS, similarity: float = SIMILARITY) -> list[tuple]:
    """(item_id, similarity, first word, words) of each item that a window of `text` matches, its best window.

    Windows have an item's size, or the text's where that is shorter. Only windows of which enough shingles occur in the
    benchmark to reach the similarity are fingerprinted; the others could not pass the last check.
    """
    if not isinstance(text, str) or not index.item_ids:
        return []
    known = index.vocabulary.get
    spelled = WORD.findall(text.lower())
    words = np.array([known(w, -1) for w in spelled], dtype=np.int64)
    if len(words) < SHINGLE:
        return []
    bad = np.concatenate(([0], np.cumsum(words < 0)))
    runs = np.flatnonzero(bad[SHINGLE:] == bad[:-SHINGLE])
    if not len(runs):
        return []
    codes = _codes(words)
    place = np.searchsorted(index.shingles, codes[runs])
    runs = runs[index.shingles[np.minimum(place, len(index.shingles) - 1)] == codes[runs]]
    if not len(runs):
        return []
    for i in np.flatnonzero(words < 0).tolist():  # only now: few texts come this far
        words[i] = -1 - zlib.crc32(spelled[i].encode("utf-8", "replace"))
    codes = _codes(words)
    hit = np.zeros(len(codes) + 1, dtype=np.int64)
    hit[runs + 1] = 1
    hit = np.cumsum(hit)
    best: dict[int, tuple[float, int, int]] = {}
    for size in np.unique(index.sizes).tolist():
        width = min(size, len(codes))
        needed = np.ceil(similarity * (size + width) / (1 + similarity) - 1e-9)
        if hit[-1] < needed:
            continue
        starts = np.flatnonzero(hit[width:] - hit[:-width] >= needed)
        for part in range(0, len(starts), 4096):
            own = starts[part : part + 4096]
            base = int(own[0])
            prints = _fingerprints(codes[base : int(own[-1]) + width], own - base, width)
            sized = np.flatnonzero(index.sizes == size)
            close = np.zeros((len(own), len(sized)), dtype=bool)
            for block, values in enumerate(_bytes_of(prints).T):
                close |= index.near[block][values][:, sized]
            for w, i in zip(*np.nonzero(close)):
                item, start = int(sized[i]), int(own[w])
                if bin(int(prints[w]) ^ int(index.fingerprints[item])).count("1") > radius:
                    continue
                found = weighted_similarity(Counter(codes[start : start + width].tolist()), index.counts[item])
                if found >= similarity and found > best.get(item, (0.0, 0, 0))[0]:
                    best[item] = (found, start, width + SHINGLE - 1)
    return [(index.item_ids[i], *best[i]) for i in sorted(best, key=lambda i: index.item_ids[i])]


def _parts(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """The benchmark in parts of about `PART_BYTES`, each small enough to broadcast."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // PART_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        yield index_items(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in items.filter(part == i).collect()))


def _matcher(shared: Broadcast) -> Callable[[Column], Column]:
    names = ("item_id", "similarity", "start_word", "n_words")

    @F.pandas_udf(MATCHES)
    def matches(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, m)) for m in match_text(text, shared.value)] for text in texts], dtype=object)

    return matches


def with_matches(documents: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """`documents` with `matches`: every benchmark item that the text holds at a similarity of 0.75 or more.

    Words are runs of letters and digits, lower-cased. Null and empty texts match nothing; items of fewer than five words
    are not searched. A column named `matches` is replaced. A repeated item id is one item per text.
    """
    found = F.array().cast(MATCHES)
    for index in _parts(benchmark):
        found = F.concat(found, _matcher(documents.sparkSession.sparkContext.broadcast(index))(F.col(column)))
    return documents.select(*[c for c in documents.columns if c != "matches"], found.alias("matches"))


def without_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item."""
    return with_matches(documents, benchmark).filter(F.size("matches") == 0).select(*documents.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item in it: similarity and place of the best window."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_matches(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
