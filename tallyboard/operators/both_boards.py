"""Metrics that read deals and work orders together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf
from tallyboard.functions.deal_rules import is_open, is_won, weighted_value
from tallyboard.functions.numbers import money_total
from tallyboard.functions.work_rules import is_delayed
from tallyboard.operators.deals import pipeline_health
from tallyboard.operators.shapes import one_row
from tallyboard.operators.work_orders import delivery_totals


def sector_analysis(deals: DataFrame, work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Commercial and delivery figures per sector of either board, zero where a board has none."""
    value, stage, status = F.col("value"), F.col("stage"), F.col("status")
    commercial = (
        deals.filter(F.col("sector") != "")
        .groupBy("sector")
        .agg(
            money_total(value).alias("total_value"),
            money_total(F.when(is_won(stage), value)).alias("won_value"),
            money_total(F.when(is_open(stage), value)).alias("active_value"),
            F.count(F.lit(1)).alias("deal_count"),
            F.count_if(is_won(stage)).alias("won_count"),
        )
    )
    delivery = (
        work_orders.filter(F.col("sector") != "")
        .groupBy("sector")
        .agg(
            F.count(F.lit(1)).alias("wo_total"),
            F.count_if(status == "Completed").alias("wo_completed"),
            F.count_if(is_delayed(status, F.col("due_date"), as_of)).alias("wo_delayed"),
            F.count_if(status == "In Progress").alias("wo_in_progress"),
        )
    )
    return commercial.join(delivery, "sector", "full").na.fill(0)


def deal_totals(deals: DataFrame) -> DataFrame:
    """One row of won and open totals, in one pass over the deals."""
    value, stage = F.col("value"), F.col("stage")
    won, still_open = is_won(stage), is_open(stage)
    return deals.agg(
        money_total(F.when(won, value)).alias("total_revenue"),
        F.count_if(won).alias("won_deals_count"),
        money_total(F.when(still_open, value)).alias("total_pipeline_value"),
        money_total(F.when(still_open, weighted_value(value, F.col("probability"), stage))).alias(
            "weighted_pipeline_value"
        ),
        F.count_if(still_open).alias("deal_count"),
    )


def business_overview(deals: DataFrame, work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Revenue, pipeline and delivery figures in one row."""
    totals = one_row(deal_totals(deals), delivery_totals(work_orders, as_of))
    total, completed, delayed = (F.col(f"{c}_work_orders") for c in ("total", "completed", "delayed"))
    return totals.select(
        "total_revenue",
        "won_deals_count",
        "total_pipeline_value",
        "weighted_pipeline_value",
        F.col("deal_count").alias("active_deals_count"),
        "total_work_orders",
        "completed_work_orders",
        "delayed_work_orders",
        (total - completed).alias("active_work_orders"),
        F.when(total > 0, delayed / total).otherwise(0.0).alias("delay_rate"),
    )


def pipeline_vs_work_orders(deals: DataFrame, work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    totals = one_row(pipeline_health(deals, as_of), delivery_totals(work_orders, as_of))
    ratio = F.col("deal_count") / F.greatest(F.col("completed_category"), F.lit(1))
    return totals.select(
        F.col("deal_count").alias("active_deals_count"),
        F.col("total_pipeline_value").alias("active_pipeline_value"),
        F.col("completed_category").alias("completed_projects_count"),
        F.col("delayed_category").alias("delayed_projects_count"),
        F.round(ratio, 2).alias("deals_to_delivery_ratio"),
    )


def general_business_health(deals: DataFrame, work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    totals = one_row(deal_totals(deals), delivery_totals(work_orders, as_of))
    return totals.select(
        F.col("total_revenue").alias("realized_revenue"),
        F.col("total_pipeline_value").alias("active_pipeline"),
        F.col("completed_category").alias("completed_projects"),
        F.col("delayed_category").alias("delayed_projects"),
    )


def all_sectors(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    both = deals.select("sector").unionByName(work_orders.select("sector"))
    return both.filter(F.col("sector") != "").distinct()


def filter_options(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Distinct owners and assignees, stages and statuses, sorted, blanks dropped."""
    offered = deals.select(F.col("owner"), F.col("stage")).unpivot([], ["owner", "stage"], "option", "value").unionByName(
        work_orders.select(F.col("assigned_to").alias("owner"), "status").unpivot([], ["owner", "status"], "option", "value")
    )
    return offered.filter(F.col("value") != "").distinct().orderBy("option", "value")
