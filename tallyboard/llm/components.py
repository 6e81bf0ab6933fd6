"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import stored

MAX_ROUNDS = 60


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """Every node links its (larger) neighbours to the smallest node among them and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger_only:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:  # links hold b > a: u is the larger end
        down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
        moved = moved.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest node) for every node of the links (a, b); nodes without links are not listed.

    Self-links and repeated links are ignored, null ends dropped. Each round is written to the shared folder; neither links
    nor nodes ever meet on the driver.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, last = stored(links, "links"), None
    for _ in range(MAX_ROUNDS):
        links = stored(_star(_star(links, True), False), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        last = state
    raise RuntimeError("the links did not settle")
