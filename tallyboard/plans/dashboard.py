"""The dashboard, whole and over filtered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf
from tallyboard.functions.text import labelled
from tallyboard.operators.deals import pipeline_health, top_open_deals
from tallyboard.operators.filters import DashboardFilters, filter_deals, filter_work_orders
from tallyboard.operators.quality import (
    data_quality,
    data_quality_filtered,
    insights_filtered_from,
    insights_from,
)
from tallyboard.operators.shapes import one_row, union_all
from tallyboard.operators.work_orders import delivery_totals
from tallyboard.plans import sections
from tallyboard.plans.cubes import BROWSER_RULES, deal_cube, order_cube
from tallyboard.sources.sinks import stage_tables

# What the sections of a dashboard read of the cubes.
DEAL_KEYS = ("stage", "month", "bucket")
ORDER_KEYS = ("category",)


def dashboard_kpis(deals: DataFrame, work_orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Six rows ``(kpi, value, description)``; delayed counts the status alone."""
    totals = one_row(pipeline_health(deals, as_of), delivery_totals(work_orders, as_of))
    return sections.kpi_rows(totals, as_of)


def charts(deals_by: DataFrame, orders_by: DataFrame, top: DataFrame, as_of: AsOf) -> list[DataFrame]:
    return [
        sections.stage_breakdown(deals_by),
        sections.forecast(deals_by, as_of),
        sections.order_status(orders_by),
        sections.largest_deals(top),
        sections.buckets(deals_by),
        sections.outcomes(deals_by),
    ]


def dashboard(
    deals: DataFrame, work_orders: DataFrame, deals_meta: DataFrame, work_orders_meta: DataFrame, as_of: AsOf
) -> DataFrame:
    """KPIs, six charts, insights and data quality.

    The cubes and the ten largest deals are written once; every section reads those.
    """
    deals_by, orders_by, top = stage_tables(
        deal_cube=deal_cube(deals, as_of, keys=DEAL_KEYS),
        order_cube=order_cube(work_orders, as_of, keys=ORDER_KEYS),
        top_deals=top_open_deals(deals),
    )
    return union_all(
        [
            sections.kpis(deals_by, orders_by, as_of, delayed="delayed_category"),
            *charts(deals_by, orders_by, top, as_of),
            sections.sentences(insights_from(sections.open_stages(deals_by), top, deals_meta)),
            sections.quality(data_quality(deals_meta, work_orders_meta)),
        ]
    )


def filtered_dashboard(
    deals: DataFrame, work_orders: DataFrame, deals_meta: DataFrame, filters: DashboardFilters, as_of: AsOf
) -> DataFrame:
    """The dashboard over filtered rows, by the browser's rules.

    Delayed includes past-due orders, deals without a stage are shown as Unknown.
    """
    deals, work_orders = filter_deals(deals, filters), filter_work_orders(work_orders, filters)
    deals_by, orders_by, top = stage_tables(
        deal_cube=deal_cube(deals, as_of, BROWSER_RULES, DEAL_KEYS),
        order_cube=order_cube(work_orders, as_of, BROWSER_RULES, ORDER_KEYS),
        top_deals=top_open_deals(deals),
    )
    shown = top.withColumn("name", labelled(F.nullif(F.col("name"), F.lit("")), "Unnamed Deal"))
    counted = deals_by.filter("section = 'stage'").agg(F.coalesce(F.sum("deal_count"), F.lit(0)).alias("all_deals"))
    return union_all(
        [
            sections.kpis(deals_by, orders_by, as_of, delayed="delayed_work_orders"),
            *charts(deals_by, orders_by, shown, as_of),
            sections.sentences(insights_filtered_from(sections.open_stages(deals_by), top, counted)),
            sections.quality(data_quality_filtered(deals, work_orders, deals_meta)),
        ]
    )
