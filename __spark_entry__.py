"""Registered queries: one per operator, with the SQL that must give the same rows.

Every query works on boards derived from the supplied tables: deals from orders and customers,
work orders from line items, parts and suppliers, messages from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle_queries import ORACLES
from tallyboard.functions import dates, deal_rules, text, work_rules
from tallyboard.functions.numbers import parse_number
from tallyboard.operators import both_boards, cleaning, deals, messages, quality, work_orders
from tallyboard.operators.filters import DashboardFilters, filter_deals, filter_work_orders
from tallyboard.operators.shapes import union_all
from tallyboard.plans import questions
from tallyboard.plans.boards import staged_board
from tallyboard.plans.dashboard import dashboard, dashboard_kpis, filtered_dashboard
from tallyboard.plans.landed import LandedSums
from tallyboard.schemas import DEALS_BOARD, RAW_ITEM, WORK_ORDERS_BOARD, page_of
from tallyboard.sources import boards, derived, laid_out, sinks

try:  # the corpus operators are optional; an error inside them is not swallowed
    import corpus_pipeline
    from tallyboard.llm import registry as corpus
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tallyboard.llm"):
        raise
    corpus_pipeline = corpus = None

AS_OF = derived.AS_OF
FILTERS = DashboardFilters(
    start_date="2000-01-01", end_date="2000-12-31", min_probability=10, max_probability=80, search="11"
)
ORDER_FILTERS = DashboardFilters(
    start_date="2000-02-01", end_date="2001-01-31", owner="Supplier#000000007", wo_status="In Progress", search="wo "
)
Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Pipeline health of the deals board, from nested items to one row."""
    items = derived.deal_items(spark, "/root/testdata/sf0.001")
    return deals.pipeline_health(cleaning.clean_board(items, DEALS_BOARD).rows, AS_OF)


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_flat(derived.flat_deals(spark, sf_dir), DEALS_BOARD)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_flat(derived.flat_work_orders(spark, sf_dir), WORK_ORDERS_BOARD)


def _deals_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.board_meta(derived.flat_deals(spark, sf_dir), DEALS_BOARD)


def _orders_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.board_meta(derived.flat_work_orders(spark, sf_dir), WORK_ORDERS_BOARD)


def _business(spark: SparkSession, sf_dir: str) -> questions.Business:
    return questions.Business(
        AS_OF,
        deals=lambda: _deals(spark, sf_dir),
        work_orders=lambda: _orders(spark, sf_dir),
        deals_meta=lambda: _deals_meta(spark, sf_dir),
        work_orders_meta=lambda: _orders_meta(spark, sf_dir),
    )


def _staged(spark: SparkSession, sf_dir: str) -> questions.Business:
    """Both boards cleaned once and stored, for reports that read them several times."""
    flat = ((derived.flat_deals(spark, sf_dir), DEALS_BOARD), (derived.flat_work_orders(spark, sf_dir), WORK_ORDERS_BOARD))
    deals_board, orders_board = sinks.in_parallel(staged_board, *zip(*flat))  # the boards do not depend on each other
    return questions.Business(
        AS_OF,
        deals=lambda: deals_board.rows,
        work_orders=lambda: orders_board.rows,
        deals_meta=lambda: deals_board.meta,
        work_orders_meta=lambda: orders_board.meta,
    )


def _shown(rows: DataFrame) -> DataFrame:
    """Dates and lists as text, the same in every engine's output."""
    shown = []
    for name, dtype in rows.dtypes:
        if dtype == "date":
            shown.append(F.col(name).cast("string").alias(name))
        elif dtype.startswith("array"):
            shown.append(F.array_join(name, ", ").alias(name))
        else:
            shown.append(F.col(name))
    return rows.select(*shown)


def _marked_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_marked(derived.flat_deals(spark, sf_dir), DEALS_BOARD)


def _of_deals(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: _shown(operator(_deals(spark, sf_dir), *args))


def _of_orders(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: _shown(operator(_orders(spark, sf_dir), *args))


def _of_both(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: _shown(operator(_deals(spark, sf_dir), _orders(spark, sf_dir), *args))


def _of_metas(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: _shown(operator(_deals_meta(spark, sf_dir), _orders_meta(spark, sf_dir)))


def _answer(route: str) -> Query:
    return lambda spark, sf_dir: _shown(questions.answer(route, _business(spark, sf_dir)))


Columns = Callable[[Callable[[str], Column]], dict[str, Column]]


def _named(columns: Columns) -> list[Column]:
    return [column.alias(name) for name, column in columns(F.col).items()]


def _deal_columns(columns: Columns) -> Query:
    return lambda spark, sf_dir: _shown(_deals(spark, sf_dir).select("id", *_named(columns)))


def _order_columns(columns: Columns) -> Query:
    return lambda spark, sf_dir: _shown(_orders(spark, sf_dir).select("id", *_named(columns)))


def _raw_deal_columns(columns: Columns) -> Query:
    return lambda spark, sf_dir: _shown(derived.raw_deals(spark, sf_dir).select("seq", *_named(columns)))


def _weighing(c: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    return c("value"), c("probability"), c("stage")


# --- sources and sinks ---


def _landed(spark: SparkSession, sf_dir: str, board: str) -> str:
    """Land a board as a chain of result pages."""
    path = sinks.fresh_path(spark, f"pages-{board}")
    if board == "deals":
        derived.land_pages(derived.raw_deals(spark, sf_dir), F.col("seq"), path, cells=derived.DEAL_CELLS)
    else:
        derived.land_pages(derived.raw_work_orders(spark, sf_dir), F.col("seq"), path, cells=derived.ORDER_CELLS)
    return path


def _page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of both boards' pages."""
    listed = (("Deals", "deals"), ("Work Orders", "work-orders"))
    return union_all([boards.page_chain(spark, _landed(spark, sf_dir, name), board) for board, name in listed])


def _damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages lost on the way: what is left of each page's items, and META with the number of pages that are missing.

    Every seventh page and the last one are lost.
    """
    whole, path = _landed(spark, sf_dir, "deals"), sinks.fresh_path(spark, "pages-damaged")
    pages = spark.read.schema(page_of(RAW_ITEM)).json(whole)
    open_end = F.coalesce("data.next_items_page.cursor", F.get("data.boards", F.lit(0))["items_page"]["cursor"]).isNotNull()
    derived.write_pages(pages.filter((F.col("page") % 7 != 3) & open_end), path)
    left = boards.scan_board_pages(spark, path, skip_bad=True).groupBy(F.col("page").cast("string").alias("field")).count()
    kept = left.select(F.lit("Deals").alias("board"), F.lit("page_items").alias("metric"), "field", "count")
    return boards.page_meta(spark, path, "Deals").unionByName(kept)


def _scan_board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = boards.scan_board_pages(spark, _landed(spark, sf_dir, "deals"))
    last = F.element_at("column_values", -1)
    return items.select(
        "page", "id", "name", F.size("column_values").alias("cells"), last["title"].alias("title"), last["text"].alias("text")
    )


def _load_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = boards.load_boards(spark, _landed(spark, sf_dir, "deals"), _landed(spark, sf_dir, "work-orders"))
    return union_all(
        [items.select(F.lit(name).alias("board"), "id", "name") for name, items in zip(("Deals", "Work Orders"), both)]
    )


def _scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals_path, orders_path = sinks.fresh_path(spark, "clean-deals"), sinks.fresh_path(spark, "clean-orders")
    _deals(spark, sf_dir).write.parquet(deals_path)
    _orders(spark, sf_dir).write.parquet(orders_path)
    tables = boards.scan_tables(spark, deals_path, orders_path)
    both = tables.deals.withColumn("board", F.lit("Deals")), tables.work_orders.withColumn("board", F.lit("Work Orders"))
    return _shown(both[0]).unionByName(_shown(both[1]), allowMissingColumns=True)


def _laid_out_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals of one owner that close within a range, from a table laid out by month."""
    path = sinks.fresh_path(spark, "laid-out-deals")
    laid_out.write_laid_out(_deals(spark, sf_dir), laid_out.DEALS_LAYOUT, path)
    return _shown(laid_out.filtered_deals(spark, path, DashboardFilters(start_date="1996-03-15", end_date="1997-08-20", owner="Rep 7")))


def _laid_out_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work orders of one status due by a day, from a table laid out by month."""
    path = sinks.fresh_path(spark, "laid-out-orders")
    laid_out.write_laid_out(_orders(spark, sf_dir), laid_out.WORK_ORDERS_LAYOUT, path)
    return _shown(laid_out.filtered_work_orders(spark, path, DashboardFilters(end_date="1995-06-15", wo_status="Completed")))


def _board_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.board_columns(derived.deal_items(spark, sf_dir), "Deals").unionByName(
        boards.board_columns(derived.work_order_items(spark, sf_dir), "Work Orders")
    )


def _sample_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.sample_items(derived.deal_items(spark, sf_dir), "Deals").unionByName(
        boards.sample_items(derived.work_order_items(spark, sf_dir), "Work Orders")
    )


def _write_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.fresh_path(spark, "records")
    rows = _deals(spark, sf_dir)
    sinks.write_records(rows, path)
    return _shown(spark.read.schema(rows.schema).json(path))


def _exported(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows as the file has them: all text, empty for null."""
    path = sinks.fresh_path(spark, "export")
    sinks.write_csv(rows, path)
    columns = ", ".join(f"{name} string" for name in rows.columns)
    return spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)


def _write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, filter_work_orders(_orders(spark, sf_dir), DashboardFilters(wo_status="In Progress")))


def _write_csv_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered deals as the report exports them; amounts are compared as numbers."""
    rows = _exported(spark, filter_deals(_deals(spark, sf_dir), FILTERS))
    return rows.withColumns({name: F.col(name).cast("double") for name in ("value", "probability")})


# --- cleaning ---


def _flatten_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.flatten_items(derived.deal_items(spark, sf_dir), DEALS_BOARD)


def _alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that come under several titles, or twice under one."""
    flat = cleaning.flatten_items(derived.deal_items(spark, sf_dir), DEALS_BOARD)
    return flat.select("seq", "sector", "stage", "owner")


def _missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deals spec against work orders: most of its fields have no title there."""
    return cleaning.missing_columns(cleaning.flatten_items(derived.work_order_items(spark, sf_dir), DEALS_BOARD), DEALS_BOARD)


def _missing_columns_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = [
        cleaning.board_meta(cleaning.flatten_items(items, spec), spec)
        for items, spec in (
            (derived.work_order_items(spark, sf_dir), DEALS_BOARD),
            (derived.deal_items(spark, sf_dir), WORK_ORDERS_BOARD),
        )
    ]
    return cleaning.missing_columns_union(*crossed)


def _dedupe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = cleaning.dedupe_items(derived.flat_work_orders(spark, sf_dir))
    return first.select("id", derived.ship_date(F.col("seq")).cast("string").alias("ship_date"), "due_date")


def _title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.concat_ws("/", F.concat_ws(" 3rd o'", F.upper("p_name"), "p_brand"), "p_type")
    return parts.select("p_partkey", text.title_case(words).alias("titled"))


def _parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in twelve spellings, and two that are no dates."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # The spellings, by order key.
    spellings = (
        "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd", "MMM d, yyyy",
        "d MMMM yyyy", "MMMM yyyy", "dd/MM/yy", "yyyy-MM", "yyyy-MM-dd'T'HH:mm:ss", "'due' dd", "yyyyMM-dd-",
    )
    day = F.col("o_orderdate").cast("timestamp_ntz")
    written = F
    for i, spelling in enumerate(spellings):
        written = written.when(F.col("o_orderkey") % len(spellings) == i, F.date_format(day, spelling))
    written = orders.select(F.col("o_orderkey").cast("string").alias("id"), written.alias("written"))
    return _shown(written.select("id", "written", dates.parse_date(F.col("written")).alias("parsed")))


def _clean_board(board: str) -> Query:
    """From nested items to clean rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if board == "deals":
            return _shown(cleaning.clean_board(derived.deal_items(spark, sf_dir), DEALS_BOARD).rows)
        return _shown(cleaning.clean_board(derived.work_order_items(spark, sf_dir), WORK_ORDERS_BOARD).rows)

    return query


def _clean_board_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """META of both boards, from nested items."""
    return cleaning.clean_board(derived.deal_items(spark, sf_dir), DEALS_BOARD).meta.unionByName(
        cleaning.clean_board(derived.work_order_items(spark, sf_dir), WORK_ORDERS_BOARD).meta
    )


def _count_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.count_missing(derived.flat_deals(spark, sf_dir), DEALS_BOARD).unionByName(
        cleaning.count_missing(derived.flat_work_orders(spark, sf_dir), WORK_ORDERS_BOARD)
    )


def _empty_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No item survives the filter; the aggregates still give their row of zeros."""
    none = derived.flat_deals(spark, sf_dir).filter("id = ''")
    return deals.pipeline_health(cleaning.clean_flat(none, DEALS_BOARD), AS_OF)


# --- reports ---


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _staged(spark, sf_dir)
    return dashboard(b.deals, b.work_orders, b.deals_meta, b.work_orders_meta, AS_OF)


def _filtered_dashboard(filters: DashboardFilters) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = _staged(spark, sf_dir)
        return filtered_dashboard(b.deals, b.work_orders, b.deals_meta, filters, AS_OF)

    return query


def _leadership_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.answer("leadership_summary", _staged(spark, sf_dir))


def _of_marked(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: operator(_marked_deals(spark, sf_dir), *args)


def _data_quality_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = filter_work_orders(_orders(spark, sf_dir), DashboardFilters(search="wo 1"))
    return _shown(quality.data_quality_filtered_marked(_marked_deals(spark, sf_dir), DashboardFilters(search="order 1"), late))


def _insights_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.insights_filtered(filter_deals(_deals(spark, sf_dir), FILTERS), AS_OF)


def _forecast_confidence_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.forecast_confidence_filtered(filter_deals(_deals(spark, sf_dir), DashboardFilters(search="order 1")))


def _quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_labels(quality.data_quality(_deals_meta(spark, sf_dir), _orders_meta(spark, sf_dir)))


def _quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_overall(quality.data_quality(_deals_meta(spark, sf_dir), _orders_meta(spark, sf_dir)))


LANDED_SHARES = ((0.0, 0.4), (0.3, 0.7), (0.6, 1.0))  # of the items' order; what two batches share comes twice


def _landed_sums(spark: SparkSession, sf_dir: str) -> LandedSums:
    """All items of both boards, landed as three batches that overlap."""
    both = ((derived.flat_deals(spark, sf_dir), DEALS_BOARD), (derived.flat_work_orders(spark, sf_dir), WORK_ORDERS_BOARD))
    ends = sinks.in_parallel(lambda one: one[0].agg(F.min("seq"), F.max("seq")).first(), both)
    sums = LandedSums(spark, sinks.fresh_path(spark, "landed-sums"))
    for number, shares in enumerate(LANDED_SHARES):
        batch = []
        for (flat, board), (first, last) in zip(both, ends):
            low, high = (first + int((last - first) * share) for share in shares)
            high = last if shares[1] == 1.0 else high  # a double does not hold every long
            batch.append(cleaning.clean_flat(flat.filter(F.col("seq").between(low, high)), board))
        sums.land(f"{number:04d}", *batch)
    return sums


def queries() -> dict[str, Query]:
    """The board queries, and those of the corpus operators where these are installed."""
    return board_queries() | (corpus.QUERIES | {"pipeline": corpus_pipeline.run} if corpus else {})


def board_queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "scan_board_pages": _scan_board_pages,
        "load_boards": _load_boards,
        "page_chain": _page_chain,
        "damaged_pages": _damaged_pages,
        "scan_tables": _scan_tables,
        "laid_out_deals": _laid_out_deals,
        "laid_out_work_orders": _laid_out_work_orders,
        "board_columns": _board_columns,
        "sample_items": _sample_items,
        "write_records": _write_records,
        "write_csv": _write_csv,
        "write_csv_deals": _write_csv_deals,
        # cleaning
        "flatten_items": _flatten_items,
        "alias_resolution": _alias_resolution,
        "missing_columns": _missing_columns,
        "missing_columns_union": _missing_columns_union,
        "dedupe_items": _dedupe_items,
        "normalize_text": _raw_deal_columns(
            lambda c: {"sector": text.normalize_text(c("sector")), "owner": text.normalize_text(c("owner")), "value": text.normalize_text(c("value"))}
        ),
        "title_case": _title_case,
        "clean_sector": _raw_deal_columns(
            lambda c: {"sector": text.clean_sector(c("sector"))}
        ),
        "clean_stage": _raw_deal_columns(
            lambda c: {"stage": text.clean_stage(c("stage"))}
        ),
        "clean_status": lambda spark, sf_dir: derived.raw_work_orders(spark, sf_dir)
        .groupBy(text.clean_status(F.col("status")).alias("status"))
        .count(),
        "parse_date": _parse_date,
        "parse_number": _raw_deal_columns(
            lambda c: {"value": parse_number(c("value")), "probability": parse_number(c("probability"))}
        ),
        "count_missing": _count_missing,
        "clean_board_meta": _clean_board_meta,
        "clean_deals": _clean_board("deals"),
        "clean_work_orders": _clean_board("work_orders"),
        "empty_board": _empty_board,
        # predicates and derived columns
        "is_open": _deal_columns(
            lambda c: {"is_open": deal_rules.is_open(c("stage"))}
        ),
        "is_won_is_lost": _deal_columns(
            lambda c: {"is_won": deal_rules.is_won(c("stage")), "is_lost": deal_rules.is_lost(c("stage"))}
        ),
        "is_overdue": _order_columns(
            lambda c: {"is_overdue": work_rules.is_overdue(c("status"), c("due_date"), AS_OF)}
        ),
        "is_delayed": _order_columns(
            lambda c: {"is_delayed": work_rules.is_delayed(c("status"), c("due_date"), AS_OF)}
        ),
        "in_quarter": _deal_columns(
            lambda c: {"in_quarter": dates.in_quarter(c("expected_close_date"), AS_OF)}
        ),
        "no_close_date": _deal_columns(
            lambda c: {"no_close_date": c("expected_close_date").isNull()}
        ),
        "close_month": _deal_columns(
            lambda c: {"month": dates.close_month(c("expected_close_date"), "Missing Date")}
        ),
        "stage_probability": _deal_columns(
            lambda c: {"percent": deal_rules.stage_probability(c("stage"))}
        ),
        "weighted_value": _deal_columns(
            lambda c: {"weighted": F.round(deal_rules.weighted_value(*_weighing(c)), 4)}
        ),
        "weighted_value_raw": _deal_columns(
            lambda c: {"weighted": F.round(deal_rules.weighted_value_raw(c("value"), c("probability")), 4)}
        ),
        "weighted_value_interactive": _deal_columns(
            lambda c: {"weighted": F.round(deal_rules.weighted_value_interactive(*_weighing(c)), 4)}
        ),
        "probability_pct": _deal_columns(
            lambda c: {"percent": deal_rules.probability_pct(c("probability"), c("stage"))}
        ),
        "probability_bucket": _deal_columns(
            lambda c: {"bucket": deal_rules.probability_bucket(deal_rules.probability_pct(c("probability"), c("stage")))}
        ),
        "delivery_category": _order_columns(
            lambda c: {"category": work_rules.delivery_category(c("status"))}
        ),
        "label_unassigned": _order_columns(
            lambda c: {"assigned_to": text.labelled(c("assigned_to"))}
        ),
        "filter_deals": _of_deals(filter_deals, FILTERS),
        "filter_work_orders": _of_orders(filter_work_orders, ORDER_FILTERS),
        # aggregations
        "pipeline_health": _of_deals(deals.pipeline_health, AS_OF),
        "pipeline_stage_totals": _of_deals(deals.pipeline_stage_totals),
        "revenue_total": _of_deals(deals.revenue_total),
        "revenue_by_sector": _of_deals(deals.revenue_by_sector),
        "revenue_by_month": _of_deals(deals.revenue_by_month),
        "sector_analysis": _of_both(both_boards.sector_analysis, AS_OF),
        "delayed_count": _of_orders(work_orders.delayed_count, AS_OF),
        "delayed_items": _of_orders(work_orders.delayed_items, AS_OF),
        "delayed_by_sector": _of_orders(work_orders.delayed_by_sector, AS_OF),
        "delayed_by_assignee": _of_orders(work_orders.delayed_by_assignee, AS_OF),
        "monthly_forecast": _of_deals(deals.monthly_forecast),
        "business_overview": _of_both(both_boards.business_overview, AS_OF),
        "opportunity_distribution": _of_deals(deals.opportunity_distribution),
        "stage_counts": _of_deals(deals.stage_counts),
        "deals_by_owner": _of_deals(deals.deals_by_owner),
        "work_orders_by_assignee": _of_orders(work_orders.work_orders_by_assignee),
        "sector_analysis_landed": lambda spark, sf_dir: _landed_sums(spark, sf_dir).sector_analysis(AS_OF),
        "deals_by_owner_landed": lambda spark, sf_dir: _landed_sums(spark, sf_dir).deals_by_owner(),
        "work_orders_by_assignee_landed": lambda spark, sf_dir: _landed_sums(spark, sf_dir).work_orders_by_assignee(),
        "pipeline_diagnostics": _of_deals(deals.pipeline_diagnostics, AS_OF),
        "mapping_profile": _of_deals(deals.mapping_profile),
        # series and top-k
        "pipeline_stage": _of_deals(deals.pipeline_stage),
        "revenue_forecast": _of_deals(deals.revenue_forecast, AS_OF),
        "work_order_status": _of_orders(work_orders.work_order_status),
        "top_deals": _of_deals(deals.top_deals),
        "closure_probability": _of_deals(deals.closure_probability),
        "top5_share": _of_deals(deals.top5_share),
        # set operations
        "filter_options": _of_both(both_boards.filter_options),
        "all_sectors": _of_both(both_boards.all_sectors),
        # data quality
        "data_quality": _of_metas(quality.data_quality),
        "data_quality_filtered": _data_quality_filtered,
        "quality_labels": _quality_labels,
        "quality_overall": _quality_overall,
        "missing_data_notes": _of_metas(quality.missing_data_notes),
        "data_completeness": _of_metas(quality.data_completeness),
        "value_complete": lambda spark, sf_dir: quality.value_complete(_deals_meta(spark, sf_dir)),
        "forecast_confidence": _of_marked(quality.forecast_confidence_marked),
        "forecast_confidence_filtered": _forecast_confidence_filtered,
        "insights": _of_marked(quality.insights_marked, AS_OF),
        "insights_filtered": _insights_filtered,
        # reports
        "dashboard_kpis": _of_both(dashboard_kpis, AS_OF),
        "dashboard": _dashboard,
        "filtered_dashboard": _filtered_dashboard(FILTERS),
        "filtered_dashboard_defaults": _filtered_dashboard(DashboardFilters()),
        "leadership_summary": _leadership_summary,
        "pipeline_summary": _answer("pipeline_summary"),
        "open_opportunities": _answer("open_opportunities"),
        "top_deals_query": _answer("top_deals"),
        "delayed_work_orders": _answer("delayed_work_orders"),
        "work_order_summary": _answer("work_order_summary"),
        "revenue_forecast_query": _answer("revenue_forecast"),
        "pipeline_vs_work_orders": _answer("pipeline_vs_work_orders"),
        "data_quality_query": _answer("data_quality"),
        "owner_analysis": _answer("owner_analysis"),
        "stage_breakdown": _answer("stage_breakdown"),
        "general_business_health": _answer("general_business_health"),
        "answer_charts": lambda spark, sf_dir: questions.charts(_staged(spark, sf_dir), *questions.CHARTS),
        "answer_completeness": lambda spark, sf_dir: questions.completeness(_business(spark, sf_dir)),
        "whole_answers": lambda spark, sf_dir: questions.whole_answers(_staged(spark, sf_dir), *questions.ANSWERS),
        # messages
        "answer_messages": lambda spark, sf_dir: _shown(
            questions.answer_messages(derived.messages(spark, sf_dir), _business(spark, sf_dir))
        ),
        "answer_conversations": lambda spark, sf_dir: _shown(
            questions.answer_messages(derived.turns(spark, sf_dir), _business(spark, sf_dir))
        ),
        "route_messages": lambda spark, sf_dir: messages.route_messages(derived.messages(spark, sf_dir)),
        "route_conversations": lambda spark, sf_dir: messages.route_messages(derived.turns(spark, sf_dir)),
        "route_volume": lambda spark, sf_dir: messages.route_volume(derived.messages(spark, sf_dir)),
        "recent_turns": lambda spark, sf_dir: messages.recent_turns(derived.messages(spark, sf_dir)),
        "recent_turns_routing": lambda spark, sf_dir: messages.recent_turns(
            derived.turns(spark, sf_dir), messages.ROUTING_TURNS
        ),
        "recent_turns_answer": lambda spark, sf_dir: messages.recent_turns(
            derived.turns(spark, sf_dir), messages.ANSWER_TURNS
        ),
        "recent_turns_archive": lambda spark, sf_dir: messages.recent_turns(derived.messages(spark, sf_dir), 5000),
    }


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if corpus:
        found |= corpus.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
