"""Interactive filters, as conjuncts that reach the scan of the clean tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.deal_rules import effective_probability


@dataclass(frozen=True)
class DashboardFilters:
    """Empty text and ``all`` leave a filter off; the date range is inclusive."""

    start_date: str = ""
    end_date: str = ""
    owner: str = "all"
    deal_stage: str = "all"
    wo_status: str = "all"
    min_probability: float = 0
    max_probability: float = 100
    search: str = ""


def _matches(columns: list[str], search: str) -> Column:
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(column)), F.lower(F.lit(search))), F.lit(False))
    return found


def _in_range(day: str, filters: DashboardFilters) -> list[Column]:
    """A row without a date is left out as soon as a bound is set."""
    bounds = []
    if filters.start_date:
        bounds.append(F.col(day) >= F.lit(filters.start_date).cast("date"))
    if filters.end_date:
        bounds.append(F.col(day) <= F.lit(filters.end_date).cast("date"))
    return bounds


def deal_conditions(deals: DataFrame, filters: DashboardFilters) -> list[Column]:
    """What a deal must meet, each a condition that can reach the scan."""
    conditions = []
    if filters.search:
        conditions.append(_matches([c for c in ("name", "client") if c in deals.columns], filters.search))
    if filters.owner != "all":
        conditions.append(F.col("owner") == filters.owner)
    if filters.deal_stage != "all":
        conditions.append(F.col("stage") == filters.deal_stage)
    probability = effective_probability(F.col("probability"), F.col("stage"), default=0.0)
    conditions.append(probability.between(filters.min_probability, filters.max_probability))
    return conditions + _in_range("expected_close_date", filters)


def filter_deals(deals: DataFrame, filters: DashboardFilters) -> DataFrame:
    """Search in name (and client, where there is one), owner, stage, probability, close date.

    The probability is the stated one, that of the stage where none is stated, 0 for others; it
    is compared as it stands, not rescaled.
    """
    return reduce(DataFrame.filter, deal_conditions(deals, filters), deals)


def filter_work_orders(work_orders: DataFrame, filters: DashboardFilters) -> DataFrame:
    """Search in name, assignee, status, due date."""
    conditions = []
    if filters.search:
        conditions.append(_matches(["name"], filters.search))
    if filters.owner != "all":
        conditions.append(F.col("assigned_to") == filters.owner)
    if filters.wo_status != "all":
        conditions.append(F.col("status") == filters.wo_status)
    return reduce(DataFrame.filter, conditions + _in_range("due_date", filters), work_orders)
