"""Roll-ups that feed whole reports: each board is aggregated once, by several keys together.

A report needs a dozen breakdowns of the same rows. Grouping sets give them all in one scan and
one shuffle of partial sums; the sections of a report then read the small result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.numbers import money_sum
from tallyboard.functions.dates import AsOf, in_quarter, month_of
from tallyboard.functions.deal_rules import (
    is_lost,
    is_won,
    probability_bucket,
    probability_pct,
    probability_pct_interactive,
    weighted_value,
    weighted_value_interactive,
    weighted_value_raw,
)
from tallyboard.functions.work_rules import delivery_category, is_delayed, is_delayed_interactive


@dataclass(frozen=True)
class Rules:
    """How a report weighs deals and tells delays; reports and the browser differ."""

    weight: Callable[[Column, Column, Column], Column]
    percent: Callable[[Column, Column], Column]
    delayed: Callable[[Column, Column, AsOf], Column]
    unknown_stage: str | None = None


REPORT_RULES = Rules(weighted_value, probability_pct, is_delayed)
BROWSER_RULES = Rules(weighted_value_interactive, probability_pct_interactive, is_delayed_interactive, "Unknown")

DEAL_KEYS = ("stage", "month", "bucket", "sector")
ORDER_KEYS = ("category", "sector", "assigned_to")


def _section(keys: tuple[str, ...]) -> tuple[Column, Column]:
    """Name and key value of the set a row belongs to: the one key not aggregated away."""
    section, key = F, F
    for name in keys:
        section = section.when(F.grouping(name) == 0, F.lit(name))
        key = key.when(F.grouping(name) == 0, F.col(name))
    return section.alias("section"), key.alias("key")


def _money(amount: Column, alias: str) -> Column:
    return money_sum(amount).alias(alias)


def deal_cube(
    deals: DataFrame, as_of: AsOf, rules: Rules = REPORT_RULES, keys: tuple[str, ...] = DEAL_KEYS
) -> DataFrame:
    """Deals by outcome and, in turn, each of ``keys``: stage, close month, probability bucket, sector.

    ``(outcome, section, key, value, weighted, weighted_raw, quarter_value, deal_count,
    quarter_count, undated)``; sums are unrounded so that they can be added up further.
    """
    value, probability, stage, day = (F.col(c) for c in ("value", "probability", "stage", "expected_close_date"))
    outcome = F.when(is_won(stage), "won").when(is_lost(stage), "lost").otherwise("open")
    label = F.coalesce(stage, F.lit(rules.unknown_stage).cast("string"))
    rows = deals.select(
        outcome.alias("outcome"),
        label.alias("stage"),
        month_of(day).alias("month"),
        probability_bucket(rules.percent(probability, stage)).alias("bucket"),
        "sector",
        "value",
        rules.weight(value, probability, stage).alias("weighted"),
        weighted_value_raw(value, probability).alias("weighted_raw"),
        F.coalesce(in_quarter(day, as_of), F.lit(False)).alias("current"),
        day.isNull().alias("undated"),
    )
    return rows.groupingSets([("outcome", key) for key in keys], "outcome", *keys).agg(
        *_section(keys),
        _money(value, "value"),
        _money(F.col("weighted"), "weighted"),
        _money(F.col("weighted_raw"), "weighted_raw"),
        _money(F.when(F.col("current"), value), "quarter_value"),
        F.count(F.lit(1)).alias("deal_count"),
        F.count_if(F.col("current")).alias("quarter_count"),
        F.count_if(F.col("undated")).alias("undated"),
    ).drop(*keys)


def order_cube(
    work_orders: DataFrame, as_of: AsOf, rules: Rules = REPORT_RULES, keys: tuple[str, ...] = ORDER_KEYS
) -> DataFrame:
    """Work orders by each of ``keys`` in turn: delivery category, sector, assignee.

    ``(section, key, total, completed, in_progress, delayed)``
    """
    status = F.col("status")
    rows = work_orders.select(
        delivery_category(status).alias("category"),
        "sector",
        "assigned_to",
        (status == "Completed").alias("completed"),
        (status == "In Progress").alias("in_progress"),
        rules.delayed(status, F.col("due_date"), as_of).alias("delayed"),
    )
    return rows.groupingSets([(key,) for key in keys], *keys).agg(
        *_section(keys),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("completed")).alias("completed"),
        F.count_if(F.col("in_progress")).alias("in_progress"),
        F.count_if(F.col("delayed")).alias("delayed"),
    ).drop(*keys)
