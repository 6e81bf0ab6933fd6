"""The leadership summary: every view of both boards as tidy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf
from tallyboard.functions.text import labelled
from tallyboard.operators.deals import top_open_deals
from tallyboard.operators.quality import data_completeness, missing_data_notes
from tallyboard.operators.shapes import one_row, tidy, union_all
from tallyboard.operators.work_orders import delayed_items
from tallyboard.plans import sections
from tallyboard.plans.cubes import deal_cube, order_cube
from tallyboard.plans.dashboard import charts
from tallyboard.sources.sinks import stage_tables


def _overview(deals_by: DataFrame, orders_by: DataFrame) -> list[DataFrame]:
    won = deals_by.filter("section = 'stage' and outcome = 'won'").agg(
        F.coalesce(F.round(F.sum("value"), 2).cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("deal_count"), F.lit(0)).alias("won_deals_count"),
    )
    totals = one_row(won, sections.open_totals(deals_by), sections.order_totals(orders_by))
    c = F.col
    total = c("total_work_orders")
    overview = {
        "total_revenue": c("total_revenue"),
        "won_deals_count": c("won_deals_count"),
        "total_pipeline_value": c("total_pipeline_value"),
        "weighted_pipeline_value": c("weighted_pipeline_value"),
        "active_deals_count": c("deal_count"),
        "total_work_orders": total,
        "completed_work_orders": c("completed_work_orders"),
        "delayed_work_orders": c("delayed_work_orders"),
        "active_work_orders": total - c("completed_work_orders"),
        "delay_rate": F.when(total > 0, c("delayed_work_orders") / total).otherwise(0.0),
    }
    health = {name: c(name) for name in sections.open_totals(deals_by).columns}
    return [tidy(totals, "business_overview", None, overview), tidy(totals, "pipeline_health", None, health)]


def _revenue(deals_by: DataFrame) -> list[DataFrame]:
    won = deals_by.filter("outcome = 'won'")
    by_sector = won.filter("section = 'sector' and key <> ''")
    by_month = won.filter("section = 'month'")
    revenue = {"revenue": sections.cents("value")}
    return [
        tidy(by_sector, "revenue_by_sector", F.col("key"), revenue),
        tidy(by_month, "revenue_by_month", labelled(F.col("key"), "Unknown"), revenue),
    ]


def _sectors(deals_by: DataFrame, orders_by: DataFrame) -> DataFrame:
    won, is_open = F.col("outcome") == "won", F.col("outcome") == "open"
    value, count = F.col("value"), F.col("deal_count")
    commercial = (
        deals_by.filter("section = 'sector' and key <> ''")
        .groupBy("key")
        .agg(
            F.sum(value).alias("total_value"),
            F.sum(F.when(won, value)).alias("won_value"),
            F.sum(F.when(is_open, value)).alias("active_value"),
            F.sum(count).alias("deal_count"),
            F.sum(F.when(won, count)).alias("won_count"),
        )
    )
    delivery = orders_by.filter("section = 'sector' and key <> ''").select(
        "key",
        F.col("total").alias("wo_total"),
        F.col("completed").alias("wo_completed"),
        F.col("delayed").alias("wo_delayed"),
        F.col("in_progress").alias("wo_in_progress"),
    )
    both = commercial.join(delivery, "key", "full")
    return tidy(both, "sector_analysis", F.col("key"), {name: sections.cents(name) for name in both.columns[1:]})


def _delays(orders_by: DataFrame, items: DataFrame) -> list[DataFrame]:
    late = orders_by.filter("delayed > 0")
    count = {"count": F.col("delayed")}
    detail = F.concat_ws(" | ", "name", "status", "sector", "due_date", "assigned_to")
    return [
        tidy(late.filter("section = 'sector'"), "delayed_by_sector", labelled(F.col("key")), count),
        tidy(late.filter("section = 'assigned_to'"), "delayed_by_assignee", labelled(F.col("key")), count),
        tidy(items, "delayed_items", F.col("id"), {"item": F.lit(None)}, detail),
    ]


def _forecast(deals_by: DataFrame) -> DataFrame:
    rows = deals_by.filter("outcome = 'open' and section = 'month'")
    measures = {
        "unweighted_value": sections.cents("value"),
        "weighted_value": sections.cents("weighted_raw"),
        "deal_count": F.col("deal_count"),
    }
    return tidy(rows, "monthly_forecast", labelled(F.col("key"), "Missing Date"), measures)


def _completeness(deals_meta: DataFrame, work_orders_meta: DataFrame) -> list[DataFrame]:
    complete = data_completeness(deals_meta, work_orders_meta)
    notes = missing_data_notes(deals_meta, work_orders_meta)
    meta = deals_meta.unionByName(work_orders_meta)
    place = F.concat_ws("/", "board", "metric", "field")
    return [
        tidy(complete, "data_completeness", None, {"is_complete": F.col("is_complete").cast("int")}),
        tidy(notes, "missing_data_notes", F.concat_ws("/", "board", "field"), {"note": F.lit(None)}, F.col("note")),
        tidy(meta, "metadata", place, {"count": F.col("count")}),
    ]


def leadership_summary(
    deals: DataFrame, work_orders: DataFrame, deals_meta: DataFrame, work_orders_meta: DataFrame, as_of: AsOf
) -> DataFrame:
    """Overview, health, revenue, sectors, delays, forecast, charts and completeness.

    Each board is aggregated once; delayed orders are listed by a second, filtered scan.
    """
    deals_by, orders_by, top = stage_tables(
        deal_cube=deal_cube(deals, as_of), order_cube=order_cube(work_orders, as_of), top_deals=top_open_deals(deals)
    )
    return union_all(
        [
            *_overview(deals_by, orders_by),
            *_revenue(deals_by),
            _sectors(deals_by, orders_by),
            *_delays(orders_by, delayed_items(work_orders, as_of)),
            _forecast(deals_by),
            *charts(deals_by, orders_by, top, as_of),
            *_completeness(deals_meta, work_orders_meta),
        ]
    )
