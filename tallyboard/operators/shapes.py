"""Small building blocks shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.sources.sinks import stage_table


def spine(spark: SparkSession, column: str, labels: tuple[str, ...]) -> DataFrame:
    """One row per label, in order, generated inside the JVM."""
    listed = F.array(*[F.lit(label) for label in labels])
    return spark.range(len(labels)).select(F.get(listed, F.col("id").cast("int")).alias(column), F.col("id").alias("nr"))


def zero_filled(labels: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """Every label with its count, 0 where nothing was counted.

    ``counted`` is grouped by a key that takes only the values of the spine, so it has at most
    that many rows and can be broadcast.
    """
    return labels.join(F.broadcast(counted), key, "left").select(key, F.coalesce("count", F.lit(0)).alias("count"))


def one_row(*totals: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), totals)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


_PLACE_IN_TASK = (1 << 33) - 1  # what `monotonically_increasing_id` counts below the task's number
_FOLDS = 64  # groups of tasks whose leaders are merged first


def with_leaders(
    rows: DataFrame, order: list[Column], leader: Column, n: int, parts: dict[str, Column], totals: dict[str, Column], *keys: str
) -> DataFrame:
    """``totals`` of the rows by ``keys``, and ``leaders``, the ``leader`` structs of the first rows by ``order``, in one pass.

    Every task sorts its rows where they are and so knows their places; an aggregate takes ``parts`` of the totals and lists
    the rows of the first ``n`` places, at most ``n`` a task. ``totals`` add up the parts. Both are merged in two steps, so
    that no task gets those of all tasks. A null ``leader`` is left out. The first ``n`` of all rows are among the leaders of
    all groups; ``first_of`` finds them.
    """
    numbered = rows.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    place, fold = F.col("_at").bitwiseAND(_PLACE_IN_TASK), F.pmod(F.shiftright("_at", 33), F.lit(_FOLDS))
    listed = F.collect_list(F.when(place < n, leader)).alias("leaders")
    folded = numbered.groupBy(*keys, fold.alias("_fold")).agg(*[c.alias(name) for name, c in parts.items()], listed)
    return folded.groupBy(*keys).agg(
        *[c.alias(name) for name, c in totals.items()], F.flatten(F.collect_list("leaders")).alias("leaders")
    )


def first_of(leaders: Column, n: int, *order: tuple[str, bool]) -> Column:
    """The first ``n`` of an array of structs by its fields, each ``(field, whether larger values come first)``."""

    def compare(a: Column, b: Column) -> Column:
        result = F.lit(0)
        for field, descending in reversed(order):
            before, after = (1, -1) if descending else (-1, 1)
            result = F.when(a[field] < b[field], before).when(a[field] > b[field], after).otherwise(result)
        return result

    return F.slice(F.array_sort(leaders, compare), 1, n)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 by ``order``, however many there are.

    Rows are sorted into ranges and stored with their place in their task, so that the places are found once; the window adds
    up one count per task.
    """
    placed = stage_table(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("_at", 33).alias("_task")
    counts = placed.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("_task", F.coalesce(earlier, F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(before), "_task")
    rank = (F.col("_before") + F.col("_at").bitwiseAND(_PLACE_IN_TASK) + 1).cast("int").alias("rank")
    return numbered.select(*rows.columns, rank)


def tidy(frame: DataFrame, section: str, key: Column | None, measures: dict[str, Column], detail: Column | None = None):
    """Rows ``(section, metric, key, value, detail)``, one per measure."""
    key = F.lit(None) if key is None else key
    detail = F.lit(None) if detail is None else detail
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            key.cast("string").alias("key"),
            value.cast("double").alias("value"),
            detail.cast("string").alias("detail"),
        )
        for metric, value in measures.items()
    ]
    return frame.select(F.inline(F.array(*rows)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
