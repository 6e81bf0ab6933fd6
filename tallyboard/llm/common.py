"""Helpers shared by the corpus operators: stored tables, sampling marks, text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.sources.sinks import stage_table


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return stage_table(df, name)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(labelled: DataFrame, label: str, key: str, rows_per_label: int) -> DataFrame:
    """About `rows_per_label` rows of each label at most, chosen by a hash of `key`: the same rows on every run."""
    counts = labelled.groupBy(label).count()
    share = F.least(F.lit(1.0), F.lit(float(rows_per_label)) / F.col("count"))
    shares = counts.select(F.col(label).alias("_label"), (share * F.lit(1 << 30)).cast("long").alias("_below"))
    marked = labelled.join(F.broadcast(shares), F.col(label) == F.col("_label"))  # one row per label
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    return marked.filter(drawn < F.col("_below")).drop("_label", "_below")


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batches_by_size(sizes: list[int], limit: int) -> Iterator[range]:
    """Consecutive index ranges whose sizes add up to about `limit`; an item above it stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield range(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield range(start, len(sizes))
