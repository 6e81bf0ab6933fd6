"""The answer of each route as one DataFrame.

A route reads only the boards its answer needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf
from tallyboard.functions.work_rules import CATEGORIES
from tallyboard.operators import both_boards, deals, quality, work_orders
from tallyboard.operators.messages import route_messages
from tallyboard.operators.shapes import ranked, tidy, union_all
from tallyboard.plans.leadership import leadership_summary
from tallyboard.schemas import DEALS_BOARD


Loader = Callable[[], DataFrame]


class Business:
    """Clean tables and metadata of both boards, and the day they are judged on.

    Tables are given as loaders and planned on first use, so that a question about one board
    never touches the other.
    """

    def __init__(
        self, as_of: AsOf, deals: Loader, work_orders: Loader, deals_meta: Loader, work_orders_meta: Loader
    ) -> None:
        self.as_of = as_of
        self._loaders = (deals, work_orders, deals_meta, work_orders_meta)

    @cached_property
    def deals(self) -> DataFrame:
        return self._loaders[0]()

    @cached_property
    def work_orders(self) -> DataFrame:
        return self._loaders[1]()

    @cached_property
    def deals_meta(self) -> DataFrame:
        return self._loaders[2]()

    @cached_property
    def work_orders_meta(self) -> DataFrame:
        return self._loaders[3]()


def pipeline_summary(b: Business) -> DataFrame:
    return deals.pipeline_health(b.deals, b.as_of)


def _whole_and_parts(counted: DataFrame, whole: str, parts: str, key: str, detail: str | None = None) -> DataFrame:
    """Tidy rows from ``counted`` (whole, key, n), in which a row for the whole board, 0 if need be, is added.

    Both come from one pass over the board; the result of the pass is summed once more with the row of zero.
    """
    zero = counted.sparkSession.range(1).select(F.lit(True).alias("whole"), F.lit(0).cast("long").alias("n"))
    keys = ["whole", key] + ([detail] if detail else [])
    summed = counted.unionByName(zero, allowMissingColumns=True).groupBy(*keys).agg(F.sum("n").alias("n"))
    listed = F.col("whole") | F.col(key).isNotNull()
    return summed.filter(listed).select(
        F.when(F.col("whole"), whole).otherwise(parts).alias("section"),
        F.when(F.col("whole") | F.lit(detail is None), "count").otherwise("item").alias("metric"),
        F.col(key).cast("string").alias("key"),
        F.when(F.col("whole") | F.lit(detail is None), F.col("n")).cast("double").alias("value"),
        (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail"),
    )


def open_opportunities(b: Business) -> DataFrame:
    """Count of open deals in all and by stage."""
    counted = deals.open_deals(b.deals).groupingSets([("stage",), ()], "stage")
    counted = counted.agg((F.grouping("stage") == 1).alias("whole"), F.count(F.lit(1)).alias("n"))
    return _whole_and_parts(counted, "open_opportunities", "opportunities_by_stage", "stage")


def top_deals(b: Business) -> DataFrame:
    return deals.top_deals(b.deals)


def delayed_work_orders(b: Business) -> DataFrame:
    """Count and list of delayed orders."""
    detail = F.concat_ws(" | ", "name", "status", "sector", "due_date", "assigned_to").alias("detail")
    items = work_orders.delayed_items(b.work_orders, b.as_of).select("id", detail)
    counted = items.groupingSets([("id", "detail"), ()], "id", "detail")
    counted = counted.agg((F.grouping("id") == 1).alias("whole"), F.count(F.lit(1)).alias("n"))
    return _whole_and_parts(counted, "delayed_work_orders", "delayed_items", "id", "detail")


def work_order_summary(b: Business) -> DataFrame:
    """All orders and their distribution over the delivery categories."""
    status = work_orders.work_order_status(b.work_orders).groupingSets([("status",), ()], "status")
    counted = status.agg((F.grouping("status") == 1).alias("whole"), F.sum("count").alias("n"))
    return _whole_and_parts(counted, "total_work_orders", "status_distribution", "status")


def revenue_forecast(b: Business) -> DataFrame:
    return deals.revenue_forecast(b.deals, b.as_of)


def pipeline_vs_work_orders(b: Business) -> DataFrame:
    return both_boards.pipeline_vs_work_orders(b.deals, b.work_orders, b.as_of)


def data_quality(b: Business) -> DataFrame:
    return quality.data_quality(b.deals_meta, b.work_orders_meta)


def owner_analysis(b: Business) -> DataFrame:
    """Open deals by owner and orders by assignee."""
    owners = deals.deals_by_owner(b.deals)
    assignees = work_orders.work_orders_by_assignee(b.work_orders)
    return union_all(
        [
            tidy(owners, "deals_by_owner", F.col("owner"), {"value": F.col("value"), "count": F.col("count")}),
            tidy(
                assignees,
                "work_orders_by_assignee",
                F.col("assigned_to"),
                {"total_count": F.col("total_count"), "delayed_count": F.col("delayed_count")},
            ),
        ]
    )


def stage_breakdown(b: Business) -> DataFrame:
    return deals.pipeline_stage(b.deals)


def leadership(b: Business) -> DataFrame:
    return leadership_summary(b.deals, b.work_orders, b.deals_meta, b.work_orders_meta, b.as_of)


def general_business_health(b: Business) -> DataFrame:
    return both_boards.general_business_health(b.deals, b.work_orders, b.as_of)


ANSWERS = {
    "pipeline_summary": pipeline_summary,
    "open_opportunities": open_opportunities,
    "top_deals": top_deals,
    "delayed_work_orders": delayed_work_orders,
    "work_order_summary": work_order_summary,
    "revenue_forecast": revenue_forecast,
    "leadership_summary": leadership,
    "pipeline_vs_work_orders": pipeline_vs_work_orders,
    "data_quality": data_quality,
    "owner_analysis": owner_analysis,
    "stage_breakdown": stage_breakdown,
    "general_business_health": general_business_health,
}


# The charts that go with the answer of a route.
CHARTS = {
    "pipeline_summary": ("pipeline_stage", "revenue_forecast"),
    "open_opportunities": ("pipeline_stage", "opportunity_distribution"),
    "top_deals": ("top_deals",),
    "delayed_work_orders": ("work_orders",),
    "work_order_summary": ("work_orders",),
    "revenue_forecast": ("revenue_forecast",),
    "pipeline_vs_work_orders": ("pipeline_stage", "work_orders"),
    "stage_breakdown": ("pipeline_stage",),
}


def _place_among(key: str, labels: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(label) for label in labels]), F.col(key)).cast("int")


def _first_rows(rows: DataFrame, *order: Column) -> DataFrame:
    """``rank`` of a report of fixed length: ten deals, the months of a horizon."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


OUTCOMES = ("Open", "Won", "Lost")


def charts(b: Business, *routes: str) -> DataFrame:
    """``(route, chart, rank, metric, key, value)``: the bars of the charts that go with the answers of the routes.

    ``rank`` is the place of a bar from 1: stages and deals by falling value, months and categories in their own order. A chart
    that several routes show is worked out once. For several charts of one board give stored tables.
    """

    def bars(chart: str, frame: DataFrame, key: str, *measures: str) -> DataFrame:
        return tidy(frame, chart, F.col(key), {m: F.col(m) for m in measures}, F.col("rank"))

    def stages() -> DataFrame:
        return ranked(deals.pipeline_stage_totals(b.deals), F.col("value").desc(), F.col("stage"))

    def months() -> DataFrame:
        return _first_rows(deals.revenue_forecast(b.deals, b.as_of), F.col("month"))

    def outcomes() -> DataFrame:
        return deals.opportunity_distribution(b.deals).withColumn("rank", _place_among("name", OUTCOMES))

    def categories() -> DataFrame:
        return work_orders.work_order_status(b.work_orders).withColumn("rank", _place_among("status", CATEGORIES))

    def top() -> DataFrame:
        return _first_rows(deals.top_open_deals(b.deals).select("id", "name", "value"), F.col("value").desc(), F.col("id"))

    drawn = {
        "pipeline_stage": lambda: bars("pipeline_stage", stages(), "stage", "value", "count"),
        "revenue_forecast": lambda: bars(
            "revenue_forecast", months(), "month", "unweighted_value", "weighted_value", "deal_count"
        ),
        "opportunity_distribution": lambda: bars("opportunity_distribution", outcomes(), "name", "value"),
        "work_orders": lambda: bars("work_orders", categories(), "status", "count"),
        "top_deals": lambda: bars("top_deals", top(), "name", "value"),
    }
    wanted = list(dict.fromkeys(chart for route in routes for chart in CHARTS.get(route, ())))
    shown_by = F
    for chart in wanted:
        names = [F.lit(route) for route in routes if chart in CHARTS.get(route, ())]
        shown_by = shown_by.when(F.col("section") == chart, F.array(*names))
    every = union_all([drawn[chart]() for chart in wanted])
    place = F.col("detail").cast("int").alias("rank")
    return every.select(F.explode(shown_by).alias("route"), F.col("section").alias("chart"), place, "metric", "key", "value")


def completeness(b: Business) -> DataFrame:
    """``(route, data_complete)``: whether the fields that an answer of the route stands on are filled.

    The pipeline summary stands on the values of deals, the leadership summary on all fields of both boards; other answers
    always count as complete.
    """
    entries = b.deals_meta.unionByName(b.work_orders_meta).filter("metric = 'missing_field' AND count > 0")
    found = entries.agg(
        (F.count_if((F.col("board") == DEALS_BOARD.board) & (F.col("field") == "value")) == 0).alias("values"),
        (F.count(F.lit(1)) == 0).alias("fields"),
    )
    stands_on = {"pipeline_summary": F.col("values"), "leadership_summary": F.col("fields")}
    rows = [F.struct(F.lit(r).alias("route"), stands_on.get(r, F.lit(True)).alias("data_complete")) for r in ANSWERS]
    return found.select(F.inline(F.array(*rows)))


def answer(route: str, business: Business) -> DataFrame:
    return ANSWERS[route](business)


# How the answers that are not tidy rows yet are listed: the column of the key and that of the detail, all others are measures.
_LISTED = {
    "pipeline_summary": (None, None),
    "top_deals": ("name", "stage"),
    "revenue_forecast": ("month", None),
    "pipeline_vs_work_orders": (None, None),
    "data_quality": ("check", "status"),
    "stage_breakdown": ("stage", None),
    "general_business_health": (None, None),
}
_LEFT_OUT = ("details", "expected_close_date")
NOTED = ("leadership_summary",)  # answers that list what is missing


def answer_rows(route: str, b: Business) -> DataFrame:
    """The answer as tidy rows ``(section, metric, key, value, detail)``."""
    frame = answer(route, b)
    if route not in _LISTED:
        return frame
    key, detail = _LISTED[route]
    measures = {c: F.col(c) for c in frame.columns if c not in (key, detail, *_LEFT_OUT)}
    return tidy(frame, route, F.col(key) if key else None, measures, F.col(detail) if detail else None)


def whole_answers(b: Business, *routes: str) -> DataFrame:
    """``(route, part, rank, section, metric, key, value, detail)``: all that belongs to the answers of the routes.

    ``part`` is ``answer``; ``chart``, whose bars have a ``rank``; ``data_complete``, 1 or 0; and ``note``, in order of ``rank``
    with its sentence as detail. Give stored tables: the parts read the boards one by one.
    """
    no_rank, text = F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string")
    tidied = ("section", "metric", "key", "value", "detail")
    parts = [answer_rows(r, b).select(F.lit(r).alias("route"), F.lit("answer").alias("part"), no_rank, *tidied) for r in routes]
    if any(r in CHARTS for r in routes):
        bars = charts(b, *[r for r in routes if r in CHARTS])
        parts.append(bars.select("route", F.lit("chart").alias("part"), "rank", F.col("chart").alias("section"), "metric", "key", "value", text.alias("detail")))
    complete = completeness(b).filter(F.col("route").isin(*routes))
    flag = F.col("data_complete").cast("int").cast("double").alias("value")
    named = [F.lit("data_complete").alias(c) for c in ("part", "section", "metric")]
    parts.append(complete.select("route", named[0], no_rank, *named[1:], text.alias("key"), flag, text.alias("detail")))
    if noted := [r for r in routes if r in NOTED]:
        notes = quality.missing_data_notes(b.deals_meta, b.work_orders_meta)
        place = F.concat_ws("/", "board", "field").alias("key")
        parts.append(
            notes.select(
                F.explode(F.array(*[F.lit(r) for r in noted])).alias("route"), F.lit("note").alias("part"), "rank",
                F.lit("missing_data_notes").alias("section"), F.lit("note").alias("metric"), place,
                F.lit(None).cast("double").alias("value"), F.col("note").alias("detail"),
            )
        )
    return union_all(parts)


def answer_sheet(b: Business) -> DataFrame:
    """``(route, data_complete, charts, notes)``: a row per route, with the names of its charts and its notes in order."""
    names = F.create_map(*[x for r in ANSWERS for x in (F.lit(r), F.array(*[F.lit(c) for c in CHARTS.get(r, ())]).cast("array<string>"))])
    listed = quality.missing_data_notes(b.deals_meta, b.work_orders_meta)
    # As many notes as the boards have fields, and no rows where nothing is missing.
    listed = listed.agg(F.array_sort(F.collect_list(F.struct("rank", "note"))).alias("listed"))
    notes = listed.select(F.explode(F.array(*[F.lit(r) for r in NOTED])).alias("route"), F.col("listed.note").alias("notes"))
    joined = completeness(b).join(F.broadcast(notes), "route", "left")  # a row per name in NOTED
    none = F.array().cast("array<string>")
    return joined.select("route", "data_complete", names[F.col("route")].alias("charts"), F.coalesce("notes", none).alias("notes"))


def answer_messages(messages: DataFrame, b: Business) -> DataFrame:
    """Each message with its route and what its answer comes with: ``data_complete``, ``charts`` and ``notes``.

    An ambiguous message is asked back: it counts as complete and has neither charts nor notes. Messages are not shuffled, the
    sheet has a row per route.
    """
    routed = route_messages(messages).join(F.broadcast(answer_sheet(b)), "route", "left")
    vague = F.coalesce("is_ambiguous", F.lit(False))  # a message without text is not ambiguous
    return routed.select(
        "conversation_id", "turn", "text", "is_ambiguous", "question", "route",
        (vague | F.col("data_complete")).alias("data_complete"),
        F.when(~vague, F.col("charts")).alias("charts"),
        F.when(~vague, F.col("notes")).alias("notes"),
    )
