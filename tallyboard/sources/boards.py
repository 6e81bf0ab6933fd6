"""Scans: landed board pages, clean tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyboard.functions.text import strip
from tallyboard.schemas import DEALS, RAW_ITEM, WORK_ORDERS, page_of


class Boards(NamedTuple):
    deals: DataFrame
    work_orders: DataFrame


_CORRUPT = "_corrupt_page"
_PLACE_BITS = 24  # an item's place in its page; the page ordinal stands above it
_ITEM_ID = StructType([RAW_ITEM["id"]])  # all of an item that the checks of a page need


def _pages(spark: SparkSession, path: str, multi_line: bool, item: StructType = RAW_ITEM) -> DataFrame:
    """Pages with their items, their place in the chain, and what is wrong with a page, null for a good one."""
    schema = StructType([*page_of(item).fields, StructField("errors", StringType()), StructField(_CORRUPT, StringType())])
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("columnNameOfCorruptRecord", _CORRUPT)
    boards, later = F.col("data.boards"), F.col("data.next_items_page")
    first = F.get(boards, F.lit(0))["items_page"]
    fault = (
        F.when(F.col(_CORRUPT).isNotNull(), "no readable document")
        .when(F.col("errors").isNotNull(), "an error document")
        .when(F.col("page").isNull(), "no page ordinal")
        .when(boards.isNull() & later["items"].isNull(), "neither a first nor a later page")
        .when((F.size(boards) > 0) & first["items"].isNull(), "a first page without items")
    )
    return reader.json(path).select(
        "page",
        F.coalesce(later["items"], first["items"]).alias("items"),
        F.coalesce(later["cursor"], first["cursor"]).alias("cursor"),
        boards.isNotNull().alias("is_first"),
        fault.alias("fault"),
        F.col("_metadata.file_path").alias("file"),
    )


def _chain(pages: DataFrame) -> DataFrame:
    """One row on how the readable pages hang together: each hands a cursor to the next, and the last has none."""
    page, ends = F.col("page"), F.col("cursor").isNull()
    totals = pages.agg(
        F.count_if(F.col("fault").isNotNull()).alias("unreadable_pages"),
        *[f.alias(name) for name, f in {
            "pages": F.count(F.when(F.col("fault").isNull(), 1)),
            "ordinals": F.count_distinct(F.when(F.col("fault").isNull(), page)),
            "least": F.min(F.when(F.col("fault").isNull(), page)),
            "greatest": F.max(F.when(F.col("fault").isNull(), page)),
            "first_pages": F.count_if(F.col("fault").isNull() & F.col("is_first")),
            "first_at": F.min(F.when(F.col("fault").isNull() & F.col("is_first"), page)),
            "last_pages": F.count_if(F.col("fault").isNull() & ends),
            "last_at": F.min(F.when(F.col("fault").isNull() & ends, page)),
        }.items()],
    )
    gaps = F.col("greatest") - F.col("least") + 1 - F.col("ordinals")
    starts = F.coalesce(F.col("first_at") == F.col("least"), F.lit(False))
    closes = F.coalesce(F.col("last_at") == F.col("greatest"), F.lit(False))
    return totals.select(
        "*",
        (F.col("pages") - F.col("ordinals")).alias("repeated_pages"),
        # Pages that are certainly missing: those between others, and one at each end that is not there.
        (F.coalesce(gaps, F.lit(0)) + F.when(starts, 0).otherwise(1) + F.when(closes, 0).otherwise(1)).alias("missing_pages"),
    )


def _broken(chain: DataFrame, skip_bad: bool) -> DataFrame:
    """Why the pages are not one whole board; null if they are, or with `skip_bad` if pages are only missing."""
    c = F.col
    problem = (
        F.when(c("repeated_pages") > 0, F.format_string("%d repeated page ordinals", "repeated_pages"))
        .when(c("first_pages") > 1, F.format_string("%d first pages", "first_pages"))
        .when((c("last_pages") > 1) | (c("last_at") < c("greatest")), F.format_string("a last page before page %d", "greatest"))
    )
    if not skip_bad:
        problem = problem.when(c("missing_pages") > 0, F.format_string("%d missing pages", "missing_pages"))
    return chain.select(problem)


def scan_board_pages(spark: SparkSession, path: str, multi_line: bool = False, skip_bad: bool = False) -> DataFrame:
    """All items of a board from its landed result pages: a whole board or none.

    One JSON document per page, with its ordinal in ``page``. ``seq``, the page ordinal and the place in the page in one
    number, is the order of the board. A page that cannot be read, holds errors or lacks the ordinal fails the query, as an
    incomplete board would pass for a complete one. So do pages that are no chain: the least ordinal is the first page, the
    ordinals are consecutive, and the greatest alone has no cursor. With ``skip_bad`` bad and missing pages are left out, and
    ``page_meta`` counts them; repeated ordinals, several first pages and a last page before others fail all the same. The
    chain is one aggregate of the ordinals and cursors, run before the items are read; a folder without pages has no items.
    """
    pages = _pages(spark, path, multi_line)
    broken = _broken(_chain(_pages(spark, path, multi_line, _ITEM_ID)), skip_bad).scalar()
    whole = F.when(broken.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad board, "), broken)).cast("boolean"))
    if skip_bad:
        pages = pages.filter("fault is null")
    else:
        told = F.raise_error(F.concat(F.lit("bad page, "), "fault", F.lit(", in "), "file")).cast(pages.schema["items"].dataType)
        pages = pages.withColumn("items", F.when(F.col("fault").isNull(), F.col("items")).otherwise(told))
        whole = F.col("fault").isNotNull() | whole  # the page itself is the better message
    pages = pages.filter(whole)
    items = pages.select("page", F.posexplode("items").alias("pos", "item"))
    return items.select(
        "page",
        "pos",
        F.shiftleft("page", _PLACE_BITS).bitwiseOR(F.col("pos").cast("long")).alias("seq"),
        F.col("item.id").alias("id"),
        F.col("item.name").alias("name"),
        F.transform(
            "item.column_values",
            lambda c: F.struct(
                c["id"].alias("id"),
                F.coalesce(c["column"]["title"], c["title"]).alias("title"),
                c["text"].alias("text"),
                c["value"].alias("value"),
            ),
        ).alias("column_values"),
    )


def page_chain(spark: SparkSession, path: str, board: str, multi_line: bool = False) -> DataFrame:
    """One row on a board's landed pages: how many there are, which are missing, repeated or unreadable, and its ends."""
    columns = ("pages", "least", "greatest", "first_pages", "last_pages", "missing_pages", "repeated_pages", "unreadable_pages")
    return _chain(_pages(spark, path, multi_line, _ITEM_ID)).select(F.lit(board).alias("board"), *columns)


def page_meta(spark: SparkSession, path: str, board: str, multi_line: bool = False) -> DataFrame:
    """META rows with the numbers of pages that ``skip_bad`` leaves out, because they are unreadable or not there."""
    metrics = ("unreadable_pages", "missing_pages")
    chain = page_chain(spark, path, board, multi_line).unpivot(["board"], list(metrics), "metric", "count")
    return chain.select("board", "metric", F.lit(None).cast("string").alias("field"), "count")


def load_boards(
    spark: SparkSession, deals_path: str, work_orders_path: str, multi_line: bool = False, skip_bad: bool = False
) -> Boards:
    """Items of both boards; nothing is read until used."""
    return Boards(*(scan_board_pages(spark, path, multi_line, skip_bad) for path in (deals_path, work_orders_path)))


def scan_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scan_tables(spark: SparkSession, deals_path: str, work_orders_path: str) -> Boards:
    """Clean tables stored as Parquet; filters and column choices reach the scan."""
    return Boards(scan_table(spark, deals_path, DEALS), scan_table(spark, work_orders_path, WORK_ORDERS))


def board_columns(items: DataFrame, board: str) -> DataFrame:
    """Column ids and titles of a board with the number of items that carry text under them."""
    cells = items.select(F.explode("column_values").alias("cell"))
    return (
        cells.groupBy(F.col("cell.id").alias("column_id"), strip(F.col("cell.title")).alias("title"))
        .agg(F.count_if(strip(F.col("cell.text")) != "").alias("items_with_value"))
        .select(F.lit(board).alias("board"), "column_id", "title", "items_with_value")
    )


def sample_items(items: DataFrame, board: str, n: int = 3) -> DataFrame:
    """Cells of the first ``n`` items; a bounded heap per task, no shuffle of the board."""
    first = items.select("seq", "id", "name", "column_values").orderBy("seq").limit(n)
    return first.select("id", "name", F.explode("column_values").alias("cell")).select(
        F.lit(board).alias("board"), "id", "name", "cell.title", "cell.text", "cell.value"
    )
