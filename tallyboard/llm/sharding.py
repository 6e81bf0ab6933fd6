"""Sharding by histogram sort: splitters found by counting exact bytes below candidate keys, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import stored

KEY_BITS = 62
ROW_BYTES = 16  # bytes that a document counts for besides its text
SUBSHARD_ROWS = 200_000


@dataclass(frozen=True)
class Splitters:
    """Rows whose (group_key, row_key) is at or above `keys[i]` belong to shard i + 1 or later."""

    keys: list[tuple[int, int]]
    rounds: int


def _key(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def with_keys(documents: DataFrame) -> DataFrame:
    """Size, crc32 and the two key parts: equal texts share `group_key`, `row_key` spreads the rows of a group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _key(text).alias("group_key"),
        _key(F.col("doc_id"), F.lit("row")).alias("row_key"),
    )


def _bytes_below(keyed: DataFrame, part: str, probes: Sequence[int]) -> np.ndarray:
    """Exact bytes of the rows whose `part` lies below each probe; the driver gets one sum per probe interval."""
    ordered = np.array(probes, dtype=np.int64)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(ordered) + 1, dtype=np.int64)
        for frame in frames:
            np.add.at(sums, np.searchsorted(ordered, frame[part].to_numpy(), side="right"), frame["size"].to_numpy())
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"place": used, "n": sums[used]})

    sums = np.zeros(len(ordered) + 1, dtype=np.int64)
    counted = keyed.select(part, "size").mapInPandas(count, "place long, n long")
    for row in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[row["place"]] = row["n"]
    return np.cumsum(sums)[:-1]


def _refine(keyed: DataFrame, part: str, goals: list[int], tolerance: float, probes: int) -> tuple[list[tuple], int]:
    """For each goal the interval [low, high) of keys around it, with the bytes below both ends.

    Every round counts the bytes below `probes` candidates per open goal. A goal is closed when an end of its interval is
    within `tolerance`, or when the interval is one key wide.
    """
    found = {i: (0, 0, 1 << KEY_BITS, None) for i in range(len(goals))}  # low, below low, high, below high
    rounds = 0

    def is_open(i: int) -> bool:
        low, under, high, over = found[i]
        near = abs(goals[i] - under) <= tolerance or (over is not None and abs(over - goals[i]) <= tolerance)
        return not near and (high - low > 1 or over is None)

    while rounds == 0 or any(is_open(i) for i in found):
        rounds += 1
        open_goals = [i for i in found if is_open(i)]
        candidates = {1 << KEY_BITS}
        for i in open_goals:
            low, _, high, _ = found[i]
            candidates.update(low + (high - low) * k // (probes + 1) for k in range(1, probes + 1))
        ordered = sorted(candidates)
        below = dict(zip(ordered, _bytes_below(keyed, part, ordered).tolist()))
        for i in open_goals:
            low, under, high, over = found[i]
            for key in ordered:
                if low < key <= high:
                    if below[key] <= goals[i]:
                        low, under = key, below[key]
                    else:
                        high, over = key, below[key]
                        break
            found[i] = (low, under, high, over if over is not None else below[1 << KEY_BITS])
    return [found[i] for i in range(len(goals))], rounds


def find_splitters(
    keyed: DataFrame, shards: int, tolerance: float = 0.002, group_tolerance: float = 0.05, probes: int = 127
) -> Splitters:
    """Splitters between `shards` shards, each within `tolerance` of a shard's bytes where row sizes allow it.

    Splitters stand between groups of equal texts. Only a group of several rows that would move a splitter by more than
    `group_tolerance` of a shard is split between its rows.
    """
    total = keyed.agg(F.sum("size").alias("n")).first()["n"] or 0
    goals = [total * (i + 1) // shards for i in range(shards - 1)]
    if not total:
        return Splitters([(1 << KEY_BITS, 0)] * len(goals), 0)
    slack = tolerance * total / shards
    ends, rounds = _refine(keyed, "group_key", goals, slack, probes)
    keys, split = [], {}
    for i, (goal, (low, under, high, over)) in enumerate(zip(goals, ends)):
        keys.append((high if abs(over - goal) < abs(goal - under) else low, 0))
        if high - low == 1 and min(abs(over - goal), abs(goal - under)) > group_tolerance * total / shards:
            split.setdefault(low, []).append((i, goal - under))
    if split:
        inside = keyed.filter(F.col("group_key").isin(list(split)))
        several = {r["group_key"] for r in inside.groupBy("group_key").count().filter("count > 1").collect()}
        for group in sorted(several):
            wanted = split[group]
            found, more = _refine(inside.filter(F.col("group_key") == group), "row_key", [g for _, g in wanted], slack, probes)
            rounds += more
            for (i, goal), (low, under, high, over) in zip(wanted, found):
                keys[i] = (group, high if abs(over - goal) < abs(goal - under) else low)
    return Splitters(keys, rounds)


def assign_shards(documents: DataFrame, shards: int, tolerance: float = 0.002) -> DataFrame:
    """Every row of `documents` (doc_id, text; others are not read) with its shard and a gapless slot in it.

    Columns doc_id, size, text_crc32, shard, slot. Null text counts as empty; repeated rows get a slot each; rows that
    agree in doc_id and text share a key and are never parted. An empty table gives no rows.
    """
    keyed = stored(with_keys(documents), "shard-keys")
    splitters = find_splitters(keyed, shards, tolerance)
    rows = keyed.count()
    group, row = F.col("group_key"), F.col("row_key")
    shard = sum(
        (((group > g) | ((group == g) & (row >= r))).cast("int") for g, r in splitters.keys), start=F.lit(0)
    )
    parts = max(1, -(-rows // (shards * SUBSHARD_ROWS)))
    part = F.pmod(F.xxhash64("row_key", "size"), F.lit(parts)).cast("int")
    placed = keyed.withColumn("shard", shard).withColumn("part", part)
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).collect()
    starts, last = [], {}
    for found in sorted(sizes, key=lambda x: (x["shard"], x["part"])):
        starts.append((found["shard"], found["part"], last.get(found["shard"], 0)))
        last[found["shard"]] = last.get(found["shard"], 0) + found["n"]
    offsets = documents.sparkSession.createDataFrame(starts, "shard int, part int, first long")
    own = Window.partitionBy("shard", "part").orderBy("group_key", "row_key", "doc_id")
    ranked = placed.withColumn("at", F.row_number().over(own) - F.lit(1))
    slotted = ranked.join(F.broadcast(offsets), ["shard", "part"])  # shards x parts rows
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    found = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shards)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
