"""A small board of each kind with rows that stress the cleaning, as nested items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2026-07-27"

DEAL_TITLES = ("Sector", "Stage", "Value", "Probability", "Expected Close Date", "Owner")
# The reference rows. d1 comes twice, d9 is untidy, d10 is empty.
DEAL_ROWS = (
    ("d1", "Mining", "Won", "150000", "100", "2026-07-15", "Alice"),
    ("d2", "Energy", "Won", "180000", "100", "2026-07-20", "Alice"),
    ("d3", "Infrastructure", "Proposal", "250000", "70", "2026-08-10", "Bob"),
    ("d4", "Mining", "Negotiation", "300000", "80", "2026-07-30", "Bob"),
    ("d5", "Agriculture", "Lead", "50000", "20", "2026-09-01", "Charlie"),
    ("d6", "Mining", "Proposal", "120000", "50", "2026-08-15", "Alice"),
    ("d7", "Infrastructure", "Won", "200000", "100", "2026-06-25", "Charlie"),
    ("d1", "Mining", "Won", "150000", "100", "2026-07-15", "Alice"),
    ("d9", "mining", "won", " 150000 ", "100%", "15/07/2026", "Alice"),
    ("d10", "", "Proposal", "", "", "", "Bob"),
)

ORDER_TITLES = ("Status", "Start Date", "Due Date", "Sector", "Assigned To")
# The reference rows. w2 is past due, w6 is untidy.
ORDER_ROWS = (
    ("w1", "Completed", "2026-06-01", "2026-06-20", "Mining", "Dave"),
    ("w2", "In Progress", "2026-06-15", "2026-07-25", "Energy", "Eve"),
    ("w3", "Delayed", "2026-07-01", "2026-08-01", "Infrastructure", "Dave"),
    ("w4", "Not Started", "2026-07-20", "2026-08-10", "Agriculture", "Eve"),
    ("w5", "Completed", "2026-05-10", "2026-06-15", "Infrastructure", "Frank"),
    ("w6", "IN PROGRESS", "2026/06/15", "25-07-2026", "energy", "Eve"),
)

ITEM = (
    "seq long, id string, name string, "
    "column_values array<struct<id: string, title: string, text: string, value: string>>"
)


def items_of(spark: SparkSession, titles: tuple[str, ...], rows: tuple[tuple, ...]) -> DataFrame:
    items = [
        (seq, row[0], f"Item {row[0]}", [(title, title, text, None) for title, text in zip(titles, row[1:])])
        for seq, row in enumerate(rows)
    ]
    return spark.createDataFrame(items, ITEM)


def deal_items(spark: SparkSession) -> DataFrame:
    return items_of(spark, DEAL_TITLES, DEAL_ROWS)


def order_items(spark: SparkSession) -> DataFrame:
    return items_of(spark, ORDER_TITLES, ORDER_ROWS)
