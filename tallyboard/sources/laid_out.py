"""Clean tables laid out for the filters of a dashboard: a folder per month, rows sorted by owner within.

A range of dates becomes a range of folders, so that a scan opens only those; an owner is found by the statistics of the files'
row groups. Rows without a date have a folder of their own, which no range touches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyboard.operators.filters import DashboardFilters, filter_deals, filter_work_orders
from tallyboard.schemas import DEALS, WORK_ORDERS

NO_MONTH = "none"


class Layout(NamedTuple):
    schema: StructType
    day: str
    owner: str

    @property
    def month(self) -> str:
        return f"{self.day}_month"


DEALS_LAYOUT = Layout(DEALS, "expected_close_date", "owner")
WORK_ORDERS_LAYOUT = Layout(WORK_ORDERS, "due_date", "assigned_to")


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def write_laid_out(rows: DataFrame, layout: Layout, path: str, mode: str = "errorifexists") -> None:
    """Store clean rows by month of ``layout.day``, sorted by ``layout.owner``.

    Rows of a month are brought together by a rebalancing exchange: small months share a task, and one with very many rows is
    split over several, each with a file of its own.
    """
    placed = rows.withColumn(layout.month, F.coalesce(_month(F.col(layout.day)), F.lit(NO_MONTH)))
    together = placed.hint("rebalance", F.col(layout.month)).sortWithinPartitions(layout.month, layout.owner)
    together.write.mode(mode).partitionBy(layout.month).parquet(path)


def scan_laid_out(
    spark: SparkSession, path: str, layout: Layout, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """Rows whose day lies in the range, ends included; a row without a day is left out as soon as a bound is set.

    The bounds also hold for the folders, so that those of other months are not listed for reading.
    """
    schema = StructType([*layout.schema.fields, StructField(layout.month, StringType())])
    rows = spark.read.schema(schema).parquet(path)
    month, day = F.col(layout.month), F.col(layout.day)
    if start_date or end_date:
        rows = rows.filter(month != NO_MONTH)
    if start_date:
        first = F.lit(start_date).cast("date")
        rows = rows.filter(month >= _month(first)).filter(day >= first)
    if end_date:
        last = F.lit(end_date).cast("date")
        rows = rows.filter(month <= _month(last)).filter(day <= last)
    return rows.drop(layout.month)


def filtered_deals(spark: SparkSession, path: str, filters: DashboardFilters) -> DataFrame:
    """``filter_deals`` of a laid-out table."""
    return filter_deals(scan_laid_out(spark, path, DEALS_LAYOUT, filters.start_date, filters.end_date), filters)


def filtered_work_orders(spark: SparkSession, path: str, filters: DashboardFilters) -> DataFrame:
    """``filter_work_orders`` of a laid-out table."""
    return filter_work_orders(scan_laid_out(spark, path, WORK_ORDERS_LAYOUT, filters.start_date, filters.end_date), filters)
