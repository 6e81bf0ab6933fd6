"""Metrics over clean deals: pipeline, revenue, forecasts, distributions, top deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf, as_of_date, close_month, in_quarter, month_of
from tallyboard.functions.deal_rules import (
    BUCKETS,
    is_lost,
    is_open,
    is_won,
    probability_bucket,
    probability_pct,
    weighted_value,
    weighted_value_raw,
)
from tallyboard.functions.numbers import money_of_list, money_of_parts, money_parts, money_total
from tallyboard.functions.text import labelled
from tallyboard.operators.shapes import first_of, spine, with_leaders, zero_filled


def _weighted() -> Column:
    return weighted_value(F.col("value"), F.col("probability"), F.col("stage"))


def _count() -> Column:
    return F.count(F.lit(1))


def open_deals(deals: DataFrame) -> DataFrame:
    return deals.filter(is_open(F.col("stage")))


def won_deals(deals: DataFrame) -> DataFrame:
    return deals.filter(is_won(F.col("stage")))


def pipeline_health(deals: DataFrame, as_of: AsOf) -> DataFrame:
    """One row over open deals, in a single aggregate."""
    current = in_quarter(F.col("expected_close_date"), as_of)
    return open_deals(deals).agg(
        money_total(F.col("value")).alias("total_pipeline_value"),
        money_total(_weighted()).alias("weighted_pipeline_value"),
        _count().alias("deal_count"),
        money_total(F.when(current, F.col("value"))).alias("current_quarter_pipeline_value"),
        F.count_if(current).alias("current_quarter_deal_count"),
        F.count_if(F.col("expected_close_date").isNull()).alias("deals_without_close_date_count"),
    )


def pipeline_stage_totals(deals: DataFrame) -> DataFrame:
    """Value and count of open deals by stage; deals without a stage are left out."""
    return (
        open_deals(deals)
        .filter(F.col("stage").isNotNull())
        .groupBy("stage")
        .agg(money_total(F.col("value")).alias("value"), _count().alias("count"))
    )


def pipeline_stage(deals: DataFrame) -> DataFrame:
    return pipeline_stage_totals(deals).orderBy(F.col("value").desc(), "stage")


def revenue_total(deals: DataFrame) -> DataFrame:
    return won_deals(deals).agg(money_total(F.col("value")).alias("total_revenue"), _count().alias("won_deals_count"))


def revenue_by_sector(deals: DataFrame) -> DataFrame:
    return (
        won_deals(deals).filter(F.col("sector") != "").groupBy("sector").agg(money_total(F.col("value")).alias("revenue"))
    )


def revenue_by_month(deals: DataFrame) -> DataFrame:
    month = close_month(F.col("expected_close_date"), "Unknown")
    return won_deals(deals).groupBy(month.alias("month")).agg(money_total(F.col("value")).alias("revenue"))


def monthly_forecast(deals: DataFrame) -> DataFrame:
    """Open deals by close month, weighted without stage defaults."""
    return (
        open_deals(deals)
        .groupBy(close_month(F.col("expected_close_date"), "Missing Date").alias("month"))
        .agg(
            money_total(F.col("value")).alias("unweighted_value"),
            money_total(weighted_value_raw(F.col("value"), F.col("probability"))).alias("weighted_value"),
            _count().alias("deal_count"),
        )
    )


def revenue_forecast(
    deals: DataFrame, as_of: AsOf, months: int = 6, weighted: Column | None = None
) -> DataFrame:
    """The next ``months`` calendar months from that of ``as_of``, zero-filled.

    Deals outside the horizon are filtered on their close date before grouping, so the grouped
    side has at most ``months`` rows.
    """
    start = F.trunc(as_of_date(as_of), "month")
    day = F.col("expected_close_date")
    grouped = (
        open_deals(deals)
        .filter((day >= start) & (day < F.add_months(start, months)))
        .groupBy(month_of(day).alias("month"))
        .agg(
            money_total(F.col("value")).alias("unweighted_value"),
            money_total(_weighted() if weighted is None else weighted).alias("weighted_value"),
            _count().alias("deal_count"),
        )
    )
    calendar = deals.sparkSession.range(months).select(
        month_of(F.add_months(start, F.col("id").cast("int"))).alias("month")
    )
    return calendar.join(F.broadcast(grouped), "month", "left").select(
        "month",
        F.coalesce("unweighted_value", F.lit(0.0)).alias("unweighted_value"),
        F.coalesce("weighted_value", F.lit(0.0)).alias("weighted_value"),
        F.coalesce("deal_count", F.lit(0)).alias("deal_count"),
    )


BY_VALUE = (("value", True), ("id", False))  # larger values first, on equal ones the lower id


def top_open_deals(deals: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the ``n`` most valuable open deals; ties go to the lower id."""
    return open_deals(deals).orderBy(F.col("value").desc(), "id").limit(n)


def top_deals(deals: DataFrame, n: int = 10) -> DataFrame:
    return top_open_deals(deals, n).select(
        "name",
        "value",
        labelled(F.col("stage"), "None").alias("stage"),
        labelled(F.col("expected_close_date").cast("string"), "None").alias("expected_close_date"),
    )


def top5_share(deals: DataFrame, n: int = 5) -> DataFrame:
    """Percent of the open value held by the ``n`` most valuable deals, in one pass."""
    value = F.col("value")
    found = with_leaders(
        open_deals(deals).select("id", "value"), [value.desc(), F.col("id")], F.struct("value", "id"), n,
        money_parts(value), {"total_value": money_of_parts(rounded=True)},
    )
    top = money_of_list(F.transform(first_of(F.col("leaders"), n, *BY_VALUE), lambda deal: deal["value"]))
    return found.select(top.alias("top_value"), "total_value").withColumn(
        "pct", F.col("top_value") / F.greatest("total_value", F.lit(1.0)) * 100
    )


def closure_probability(deals: DataFrame, pct: Column | None = None) -> DataFrame:
    """Open deals in five probability buckets, zero-filled."""
    pct = probability_pct(F.col("probability"), F.col("stage")) if pct is None else pct
    counted = open_deals(deals).groupBy(probability_bucket(pct).alias("range")).count()
    return zero_filled(spine(deals.sparkSession, "range", BUCKETS), "range", counted)


def opportunity_distribution(deals: DataFrame) -> DataFrame:
    """Open, won and lost counts, always three rows."""
    stage = F.col("stage")
    counts = deals.agg(
        F.count_if(is_open(stage)).alias("open"),
        F.count_if(is_won(stage)).alias("won"),
        F.count_if(is_lost(stage)).alias("lost"),
    )
    return counts.select(F.expr("stack(3, 'Open', open, 'Won', won, 'Lost', lost) as (name, value)"))


def stage_counts(deals: DataFrame) -> DataFrame:
    return open_deals(deals).filter(F.col("stage").isNotNull()).groupBy("stage").count()


def deals_by_owner(deals: DataFrame) -> DataFrame:
    return (
        open_deals(deals)
        .filter(F.col("owner").isNotNull())
        .groupBy("owner")
        .agg(money_total(F.col("value")).alias("value"), _count().alias("count"))
    )


def pipeline_diagnostics(deals: DataFrame, as_of: AsOf) -> DataFrame:
    """Counts that show where a pipeline total goes missing."""
    current = in_quarter(F.col("expected_close_date"), as_of)
    return open_deals(deals).agg(
        _count().alias("open_rows"),
        money_total(F.col("value")).alias("value_sum"),
        F.count("value").alias("values_present"),
        F.count("expected_close_date").alias("close_dates_present"),
        F.count_if(current).alias("quarter_rows"),
        money_total(F.when(current, F.col("value"))).alias("quarter_value"),
    )


def mapping_profile(deals: DataFrame) -> DataFrame:
    """Distinct sectors, stages and owners."""
    columns = ["sector", "stage", "owner"]
    return (
        deals.select(*columns)
        .unpivot([], columns, "field", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )
