"""Boards and messages derived from the supplied tables.

``raw_*`` give one text column per field, ``flat_*`` the same stripped, the state after
``flatten_items``; ``*_items`` pack the raw rows into nested cells, the state before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.sources.sinks import stage_table

AS_OF = "2000-07-27"
PAGE_ITEMS = 100  # items of a landed result page
TASK_ITEMS = 200_000  # items with their cells that a task holds while it makes pages of them

# One message per index, over all routes, three ambiguous ones and a trap
# ("stop" contains "top").
PHRASES = (
    "Prepare the leadership brief",
    "Compare pipeline versus delivery",
    "Which fields have MISSING values?",
    "Show workload by assignee",
    "Stage breakdown please",
    "What are our largest accounts?",
    "Forecast for the coming months",
    "Which jobs are overdue?",
    "List every project",
    "How many opportunities are there?",
    "How are sales going?",
    "Good morning",
    " Status ",
    "how are we doing",
    "REPORT",
    "Please stop the pipeline alerts",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules of each text column over orders and customers; ``k`` is the order key.
_DEAL_RULES = {
    "sector": """CASE WHEN c_mktsegment = 'BUILDING' THEN 'construction' WHEN c_mktsegment = 'MACHINERY' THEN ' mining '
        WHEN c_mktsegment = 'AUTOMOBILE' THEN 'POWER' WHEN c_mktsegment = 'FURNITURE' THEN 'agri'
        WHEN k % 2 = 0 THEN '' END""",
    "stage": """CASE WHEN k % 37 = 0 THEN NULL
        WHEN o_orderstatus = 'F' AND left(o_orderpriority, 1) <= '3' THEN 'closed won'
        WHEN o_orderstatus = 'F' THEN 'LOST DEAL'
        WHEN left(o_orderpriority, 1) = '1' THEN 'f. negotiations' WHEN left(o_orderpriority, 1) = '2' THEN 'PROPOSAL'
        WHEN left(o_orderpriority, 1) = '3' THEN 'lead' WHEN left(o_orderpriority, 1) = '4' THEN 'C. demo done'
        ELSE 'm. projects on hold' END""",
    "value": """CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN '' WHEN k % 47 = 0 THEN 'tbd'
        WHEN k % 3 = 0 THEN '$' || format_number(o_totalprice, 2)
        ELSE '  ' || CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS STRING) || ' ' END""",
    "probability": "get(array(NULL, '', '0', '0.45', '70%', '55', '100'), CAST(k % 7 AS INT))",
    "expected_close_date": """CASE WHEN k % 29 = 0 THEN NULL WHEN k % 53 = 0 THEN 'soon'
        WHEN k % 4 = 0 THEN CAST(day AS STRING) WHEN k % 4 = 1 THEN translate(CAST(day AS STRING), '-', '/')
        WHEN k % 4 = 2 THEN date_format(day, 'dd-MM-yyyy') ELSE date_format(day, 'MM/dd/yyyy') END""",
    "owner": "CASE WHEN k % 31 = 0 THEN '' ELSE 'Rep ' || c_nationkey END",
}

# The rules of each text column over line items, parts and suppliers.
_ORDER_RULES = {
    "status": """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'COMPLETED' WHEN 'AO' THEN 'active' WHEN 'NF' THEN 'backlog'
        WHEN 'NO' THEN 'Overdue' WHEN 'RF' THEN 'canceled' ELSE CASE l_partkey % 3
        WHEN 1 THEN 'executed until current month' WHEN 2 THEN 'done' END END""",
    "start_date": "CAST(date_sub(shipped, 30) AS STRING)",
    "due_date": """CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN date_format(shipped, 'dd-MM-yyyy')
        ELSE CAST(shipped AS STRING) END""",
    "sector": "get(array('MINING', 'renewables', 'Infra', 'agro', NULL), p_size % 5)",
    "assigned_to": "CASE WHEN l_suppkey % 19 = 0 THEN '' ELSE s_name END",
}


def _written(rules: dict[str, str]) -> list[str]:
    return [f"{rule} AS {name}" for name, rule in rules.items()]


def raw_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals as text from orders and customers; every twentieth order comes twice."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .selectExpr(
            "o_orderkey AS k", "CAST(o_orderdate AS DATE) AS day", "o_orderstatus", "o_orderpriority", "o_totalprice",
            "c_mktsegment", "c_nationkey", "explode(IF(o_orderkey % 20 = 0, array(0, 1), array(0))) AS copy",
        )
        .selectExpr(
            "k * 2 + copy AS seq", "CAST(k AS STRING) AS id",
            "'Order ' || k || IF(copy = 1, ' (copy)', '') AS name", *_written(_DEAL_RULES),
        )
    )


# Ship date, part and supplier in one number, for up to 2 ** 28 parts and 2 ** 21 suppliers.
_ORDER_SEQ = "shiftleft(CAST(datediff(shipped, DATE '1970-01-01') AS BIGINT), 49) | shiftleft(l_partkey, 21) | l_suppkey"


def ship_date(seq: Column) -> Column:
    """Day that `seq` of a work order begins with."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.shiftright(seq, 49).cast("int"))


def raw_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work orders as text from line items, parts and suppliers; ids repeat naturally."""
    lines, parts = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    suppliers = _table(spark, sf_dir, "supplier")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .withColumn("shipped", F.col("l_shipdate").cast("date"))
        .selectExpr(
            f"{_ORDER_SEQ} AS seq",
            "l_orderkey || '-' || l_linenumber AS id", "'WO ' || l_orderkey || '-' || l_linenumber AS name",
            *_written(_ORDER_RULES),
        )
    )


def flat_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw deals as ``flatten_items`` gives them: stripped, every field's title present."""
    stripped = {"sector": F.trim("sector"), "value": F.trim("value")}
    return raw_deals(spark, sf_dir).withColumns(stripped | {"titles_present": F.expr("63L")})


def flat_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw work orders as ``flatten_items`` gives them; none of their text is padded."""
    return raw_work_orders(spark, sf_dir).withColumn("titles_present", F.expr("31L"))


_KEY = "(seq div 2)"  # order key of a deal

# Cells of a deal, in order: when present, title, text.
_DEAL_CELLS = (
    (f"{_KEY} % 2 = 0", "Sector", "sector"),
    (f"{_KEY} % 2 <> 0", "Sector/service", "sector"),
    (f"{_KEY} % 13 = 0", "Stage", "'Lead'"),
    ("true", " Stage", "stage"),
    ("true", "Masked Deal value", "value"),
    ("true", "Probability", "probability"),
    ("true", "Expected Close Date", "expected_close_date"),
    (f"{_KEY} % 11 = 0", "Owner", "'Former Rep'"),
    ("true", "Owner code", "owner"),
)
_ORDER_CELLS = (
    ("true", "Status", "status"),
    ("true", "Work Order Date", "start_date"),
    ("true", "Due Date", "due_date"),
    ("true", "Sector/Service", "sector"),
    ("true", "Assigned To", "assigned_to"),
)


def _cells(listed: tuple[tuple[str, str, str], ...]) -> str:
    cells = [
        f"IF({present}, named_struct('id', '{'col_' + title.lower().replace(' ', '_')}', 'title', '{title}', "
        f"'text', {text}, 'value', '\"' || {text} || '\"'), NULL)"
        for present, title, text in listed
    ]
    return f"array_compact(array({', '.join(cells)}))"


DEAL_CELLS, ORDER_CELLS = _cells(_DEAL_CELLS), _cells(_ORDER_CELLS)  # of a row of `raw_deals` or `raw_work_orders`


def deal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals as nested items.

    Sector alternates between two titles, every eleventh order carries an outdated owner under
    an earlier title, every thirteenth its stage twice, so that aliases and repeated titles count.
    """
    return raw_deals(spark, sf_dir).selectExpr("seq", "id", "name", f"{DEAL_CELLS} AS column_values")


def work_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_work_orders(spark, sf_dir).selectExpr("seq", "id", "name", f"{ORDER_CELLS} AS column_values")


def land_pages(
    items: DataFrame, order: Column, path: str, page_items: int = PAGE_ITEMS, cells: str = "column_values"
) -> None:
    """Write items as a chain of result pages of ``page_items`` each, in the given order.

    Page 0 has the shape of a first page, the rest that of later ones; all but the last hand on a cursor. ``cells`` is SQL for
    an item's cells: the sorted rows are stored, and brought together by page, without them. An item's number is its file's
    first one plus its place in the file: no window over the whole board.
    """
    stored = stage_table(items.orderBy(order), "sorted-items")
    total = stored.count()  # of the files' footers
    place = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = place.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))  # a row for each file that a task wrote
    files = files.select("_file", (F.sum("_rows").over(Window.orderBy("_file")) - F.col("_rows")).alias("_before"))
    numbered = place.join(F.broadcast(files), "_file").withColumn("nth", F.col("_before") + F.col("_place"))
    paged = numbered.drop("_file", "_place", "_before").withColumn("page", F.expr(f"nth div {page_items}"))
    together = paged.repartition(max(1, math.ceil(total / TASK_ITEMS)), "page")
    listed = F.transform(
        F.expr(cells),
        lambda c: F.struct(c["id"].alias("id"), F.struct(c["title"].alias("title")).alias("column"), c["text"], c["value"]),
    )
    item = F.struct("id", "name", listed.alias("column_values"))
    pages = together.select("page", F.struct("nth", item.alias("item")).alias("numbered")).groupBy("page").agg(
        F.array_sort(F.collect_list("numbered")).alias("own"),  # at most `page_items`
    )
    cursor = F.when(F.col("page") < (total - 1) // page_items, F.concat(F.lit("after-"), "page"))
    listed = F.struct(cursor.alias("cursor"), F.transform("own", lambda x: x["item"]).alias("items"))
    first = F.col("page") == 0
    data = F.struct(
        F.when(first, F.array(F.struct(listed.alias("items_page")))).alias("boards"),
        F.when(~first, listed).alias("next_items_page"),
    )
    write_pages(pages.select("page", data.alias("data")), path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Result pages as compressed JSON lines: titles and ids of columns come again in every item."""
    pages.write.option("compression", "gzip").json(path)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from events: one conversation per user, ordered by event."""
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("event_id") % len(PHRASES)).cast("int"))
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conversation_id"),
        F.col("event_id").alias("turn"),
        F.lit("user").alias("role"),
        phrase.alias("text"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", "text"
    )
