"""Breakdowns from sums stored per landed batch: a new batch is read alone, earlier ones are never read again.

What depends on the day of the report is not added up before that day is known: stages, statuses and due dates are keys of
the stored sums, and the rules are applied when batches are merged.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf
from tallyboard.functions.deal_rules import is_open, is_won
from tallyboard.functions.numbers import money_of_parts, money_parts
from tallyboard.functions.text import strip
from tallyboard.functions.work_rules import is_delayed
from tallyboard.sources.sinks import in_parallel, stage_table, temporary_tables

BATCH_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
IDS = "id string, batch string"
DEAL_SUMS = "section string, key string, stage string, exact decimal(38,6), rest double, n long, batch string"
ORDER_SUMS = "section string, key string, status string, due_date date, n long, batch string"
SUMMED = {"deals": ("sector", "owner", "stage", "value"), "orders": ("sector", "assigned_to", "status", "due_date")}


def deal_sums(deals: DataFrame) -> DataFrame:
    """Value and number of deals per sector and stage, and per owner and stage, in parts that add up without loss."""
    section = F.when(F.grouping("sector") == 0, "sector").otherwise("owner")
    key = F.when(F.grouping("sector") == 0, F.col("sector")).otherwise(F.col("owner"))
    parts = {"section": section, "key": key, **money_parts(F.col("value")), "n": F.count(F.lit(1))}
    sums = deals.groupingSets([("sector", "stage"), ("owner", "stage")], "sector", "owner", "stage")
    return sums.agg(*[part.alias(name) for name, part in parts.items()]).drop("sector", "owner")


def order_sums(work_orders: DataFrame) -> DataFrame:
    """Number of work orders per sector, status and due date, and per assignee and status."""
    section = F.when(F.grouping("sector") == 0, "sector").otherwise("assigned_to")
    key = F.when(F.grouping("sector") == 0, F.col("sector")).otherwise(F.col("assigned_to"))
    sets = [("sector", "status", "due_date"), ("assigned_to", "status")]
    sums = work_orders.groupingSets(sets, "sector", "assigned_to", "status", "due_date")
    return sums.agg(section.alias("section"), key.alias("key"), F.count(F.lit(1)).alias("n")).drop("sector", "assigned_to")


class LandedSums:
    """Sums of both boards below ``path``, a folder per batch.

    Batches are landed one after another, in the order of their items: of an id that comes again the row of the earliest
    batch counts, as in ``dedupe_items``. A batch counts once `land` has ended; one that was broken off is landed again under
    its name and replaces what it left. What has been landed cannot be landed anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def batches(self) -> list[str]:
        """Names of the batches that count; one small file each."""
        files, place = self._place("landed/*")
        return sorted(status.getPath().getName() for status in files.globStatus(place) or [])

    def _table(self, kind: str, schema: str) -> DataFrame:
        landed = self.batches()
        if not landed:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").filter(F.col("batch").isin(landed))

    def land(self, batch: str, deals: DataFrame, work_orders: DataFrame) -> None:
        """Add a batch of clean rows, of which each id comes once. Either board may be empty.

        The rows are read once. Of earlier batches the ids alone are read, and met with the rows in one join, whose result is
        stored while it is added up; a first batch is stored as it comes.
        """
        if not BATCH_NAME.fullmatch(batch):
            raise ValueError(f"not a name of a folder: {batch!r}")
        if batch in self.batches():
            raise ValueError(f"{batch} has been landed")
        with temporary_tables(self.spark):  # the boards do not depend on each other
            in_parallel(self._add, (batch, batch), ("deals", "orders"), (deals, work_orders), (deal_sums, order_sums))
        files, place = self._place(f"landed/{batch}")
        files.create(place, False).close()

    def _add(self, batch: str, board: str, rows: DataFrame, sums: Callable[[DataFrame], DataFrame]) -> None:
        if self.batches():
            earlier = self._table(f"{board}-ids", IDS).select("id")
            if not earlier.filter("id IS NULL").isEmpty():  # null ids are few, often none: row groups without are skipped
                rows = rows.filter("id IS NOT NULL")
            rows = rows.join(earlier, "id", "left_anti")  # by plain equality, so that rows shuffled by id stay where they are
        new = stage_table(rows.select("id", *SUMMED[board]), f"landing-{board}")
        sums(new).write.mode("overwrite").parquet(f"{self.path}/{board}-sums/batch={batch}")
        new.select("id").write.mode("overwrite").parquet(f"{self.path}/{board}-ids/batch={batch}")

    def _deals(self, section: str) -> DataFrame:
        return self._table("deals-sums", DEAL_SUMS).filter(F.col("section") == section)

    def _orders(self, section: str) -> DataFrame:
        return self._table("orders-sums", ORDER_SUMS).filter(F.col("section") == section)

    def sector_analysis(self, as_of: AsOf) -> DataFrame:
        """``operators.both_boards.sector_analysis`` of all that has been landed."""
        stage, status = F.col("stage"), F.col("status")
        commercial = self._deals("sector").filter("key <> ''").groupBy(F.col("key").alias("sector"))
        commercial = commercial.agg(
            _money().alias("total_value"),
            _money(is_won(stage)).alias("won_value"),
            _money(is_open(stage)).alias("active_value"),
            F.sum("n").alias("deal_count"),
            _number(is_won(stage)).alias("won_count"),
        )
        delivery = self._orders("sector").filter("key <> ''").groupBy(F.col("key").alias("sector"))
        delivery = delivery.agg(
            F.sum("n").alias("wo_total"),
            _number(status == "Completed").alias("wo_completed"),
            _number(is_delayed(status, F.col("due_date"), as_of)).alias("wo_delayed"),
            _number(status == "In Progress").alias("wo_in_progress"),
        )
        return commercial.join(delivery, "sector", "full").na.fill(0)

    def deals_by_owner(self) -> DataFrame:
        """``operators.deals.deals_by_owner`` of all that has been landed."""
        still_open = self._deals("owner").filter(is_open(F.col("stage"))).filter(F.col("key").isNotNull())
        return still_open.groupBy(F.col("key").alias("owner")).agg(_money().alias("value"), F.sum("n").alias("count"))

    def work_orders_by_assignee(self) -> DataFrame:
        """``operators.work_orders.work_orders_by_assignee`` of all that has been landed."""
        delayed = F.lower(strip(F.col("status"))).isin("delayed", "overdue")
        assigned = self._orders("assigned_to").filter(F.col("key").isNotNull()).groupBy(F.col("key").alias("assigned_to"))
        return assigned.agg(F.sum("n").alias("total_count"), _number(delayed).alias("delayed_count"))


def _money(which: Column | None = None) -> Column:
    return money_of_parts(rounded=True, which=which)


def _number(which: Column) -> Column:
    return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0).cast("long"))
