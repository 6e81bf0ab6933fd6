"""Metrics over clean work orders: delays, delivery categories, load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf
from tallyboard.functions.text import labelled, strip
from tallyboard.functions.work_rules import CATEGORIES, delivery_category, is_delayed
from tallyboard.operators.shapes import spine, zero_filled


def _delayed(as_of: AsOf):
    return is_delayed(F.col("status"), F.col("due_date"), as_of)


def delayed_orders(work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Rows that carry the delayed status or are past their due date and not completed."""
    return work_orders.filter(_delayed(as_of))


def delayed_count(work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    return delayed_orders(work_orders, as_of).agg(F.count(F.lit(1)).alias("total_delayed_count"))


def delayed_items(work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    return delayed_orders(work_orders, as_of).select(
        "id",
        "name",
        labelled(F.col("status"), "None").alias("status"),
        labelled(F.col("sector")).alias("sector"),
        labelled(F.col("due_date").cast("string"), "None").alias("due_date"),
        labelled(F.col("assigned_to")).alias("assigned_to"),
    )


def delayed_by_sector(work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    return delayed_orders(work_orders, as_of).groupBy(labelled(F.col("sector")).alias("sector")).count()


def delayed_by_assignee(work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    return delayed_orders(work_orders, as_of).groupBy(labelled(F.col("assigned_to")).alias("assigned_to")).count()


def work_order_status(work_orders: DataFrame) -> DataFrame:
    """Counts per delivery category, zero-filled."""
    counted = work_orders.groupBy(delivery_category(F.col("status")).alias("status")).count()
    return zero_filled(spine(work_orders.sparkSession, "status", CATEGORIES), "status", counted)


def delivery_totals(work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    """One row: all orders, completed and delayed ones, both by exact status and by category."""
    category = delivery_category(F.col("status"))
    return work_orders.agg(
        F.count(F.lit(1)).alias("total_work_orders"),
        F.count_if(F.col("status") == "Completed").alias("completed_work_orders"),
        F.count_if(_delayed(as_of)).alias("delayed_work_orders"),
        F.count_if(category == "Completed").alias("completed_category"),
        F.count_if(category == "Delayed").alias("delayed_category"),
    )


def work_orders_by_assignee(work_orders: DataFrame) -> DataFrame:
    """Load per assignee; delayed means the status alone, not the due date."""
    delayed = F.lower(strip(F.col("status"))).isin("delayed", "overdue")
    return (
        work_orders.filter(F.col("assigned_to").isNotNull())
        .groupBy("assigned_to")
        .agg(F.count(F.lit(1)).alias("total_count"), F.count_if(delayed).alias("delayed_count"))
    )
