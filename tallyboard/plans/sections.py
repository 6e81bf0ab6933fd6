"""Report sections as tidy rows ``(section, metric, key, value, detail)``, drawn from the cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf, as_of_date, month_of
from tallyboard.functions.deal_rules import BUCKETS
from tallyboard.functions.numbers import money_total
from tallyboard.functions.text import labelled
from tallyboard.functions.work_rules import CATEGORIES
from tallyboard.operators.shapes import one_row, spine, tidy


def cents(column: str):
    return F.coalesce(F.round(column, 2).cast("double"), F.lit(0.0))


def open_stages(cube: DataFrame) -> DataFrame:
    return cube.filter("outcome = 'open' and section = 'stage'").withColumnRenamed("key", "stage")


def open_totals(cube: DataFrame) -> DataFrame:
    """One row over open deals, with the columns of ``pipeline_health``."""
    return open_stages(cube).agg(
        money_total(F.col("value")).alias("total_pipeline_value"),
        money_total(F.col("weighted")).alias("weighted_pipeline_value"),
        F.coalesce(F.sum("deal_count"), F.lit(0)).alias("deal_count"),
        money_total(F.col("quarter_value")).alias("current_quarter_pipeline_value"),
        F.coalesce(F.sum("quarter_count"), F.lit(0)).alias("current_quarter_deal_count"),
        F.coalesce(F.sum("undated"), F.lit(0)).alias("deals_without_close_date_count"),
    )


def order_totals(cube: DataFrame) -> DataFrame:
    """One row over work orders: totals by exact status and by category."""
    rows = cube.filter("section = 'category'")
    totals = {
        "total_work_orders": F.sum("total"),
        "completed_work_orders": F.sum("completed"),
        "delayed_work_orders": F.sum("delayed"),
        "completed_category": F.sum(F.when(F.col("key") == "Completed", F.col("total"))),
        "delayed_category": F.sum(F.when(F.col("key") == "Delayed", F.col("total"))),
    }
    return rows.agg(*[F.coalesce(total, F.lit(0)).alias(name) for name, total in totals.items()])


def kpi_rows(totals: DataFrame, as_of: AsOf, delayed: str = "delayed_category") -> DataFrame:
    """Six rows ``(kpi, value, description)`` from pipeline and delivery totals in one row."""
    quarter_text = F.format_string(
        "Forecasted to close in Q%d (%d deals)", F.quarter(as_of_date(as_of)), F.col("current_quarter_deal_count")
    )
    # Names, order and descriptions of the KPIs.
    kpis = [
        ("total_pipeline", "total_pipeline_value", F.lit("Total value of all open deals")),
        ("weighted_pipeline", "weighted_pipeline_value", F.lit("Risk-adjusted active value")),
        ("open_opportunities", "deal_count", F.lit("Active sales opportunities")),
        ("current_quarter_pipeline", "current_quarter_pipeline_value", quarter_text),
        ("completed_work_orders", "completed_category", F.lit("Successfully delivered contracts")),
        ("delayed_work_orders", delayed, F.lit("Projects experiencing execution delays")),
    ]
    rows = [
        F.struct(
            F.lit(name).alias("kpi"), F.col(column).cast("double").alias("value"), text.alias("description")
        )
        for name, column, text in kpis
    ]
    return totals.select(F.inline(F.array(*rows)))


def kpis(deal_cube: DataFrame, order_cube: DataFrame, as_of: AsOf, delayed: str) -> DataFrame:
    rows = kpi_rows(one_row(open_totals(deal_cube), order_totals(order_cube)), as_of, delayed)
    return tidy(rows, "kpis", F.col("kpi"), {"value": F.col("value")}, F.col("description"))


def stage_breakdown(cube: DataFrame) -> DataFrame:
    rows = open_stages(cube).filter("stage is not null")
    return tidy(rows, "pipeline_stage", F.col("stage"), {"value": cents("value"), "count": F.col("deal_count")})


def forecast(cube: DataFrame, as_of: AsOf, months: int = 6) -> DataFrame:
    start = F.trunc(as_of_date(as_of), "month")
    calendar = cube.sparkSession.range(months).select(month_of(F.add_months(start, F.col("id").cast("int"))).alias("key"))
    by_month = cube.filter("outcome = 'open' and section = 'month'").filter(
        F.col("key").between(month_of(start), month_of(F.add_months(start, months - 1)))
    )
    return tidy(
        calendar.join(F.broadcast(by_month), "key", "left"),
        "revenue_forecast",
        F.col("key"),
        {
            "unweighted_value": cents("value"),
            "weighted_value": cents("weighted"),
            "deal_count": F.coalesce("deal_count", F.lit(0)),
        },
    )


def order_status(cube: DataFrame) -> DataFrame:
    counted = cube.filter("section = 'category'").select("key", "total")
    filled = spine(cube.sparkSession, "key", CATEGORIES).join(F.broadcast(counted), "key", "left")
    return tidy(filled, "work_orders", F.col("key"), {"count": F.coalesce("total", F.lit(0))})


def largest_deals(top: DataFrame) -> DataFrame:
    detail = F.concat_ws(
        ", ", labelled(F.col("stage"), "None"), labelled(F.col("expected_close_date").cast("string"), "None")
    )
    return tidy(top, "top_deals", F.col("name"), {"value": F.col("value")}, detail)


def buckets(cube: DataFrame) -> DataFrame:
    counted = cube.filter("outcome = 'open' and section = 'bucket'").select("key", "deal_count")
    filled = spine(cube.sparkSession, "key", BUCKETS).join(F.broadcast(counted), "key", "left")
    return tidy(filled, "probability_distribution", F.col("key"), {"count": F.coalesce("deal_count", F.lit(0))})


def outcomes(cube: DataFrame) -> DataFrame:
    counted = cube.filter("section = 'stage'").groupBy(F.initcap("outcome").alias("key")).agg(F.sum("deal_count").alias("n"))
    filled = spine(cube.sparkSession, "key", ("Open", "Won", "Lost")).join(F.broadcast(counted), "key", "left")
    return tidy(filled, "opportunity_distribution", F.col("key"), {"count": F.coalesce("n", F.lit(0))})


def sentences(insights: DataFrame) -> DataFrame:
    return tidy(insights, "insights", F.col("rank"), {"insight": F.lit(None)}, F.col("insight"))


def quality(checks: DataFrame) -> DataFrame:
    detail = F.concat_ws(" ", F.col("status"), F.array_join("details", ", "))
    return tidy(checks, "data_quality", F.col("check"), {"count": F.col("count")}, F.trim(detail))
