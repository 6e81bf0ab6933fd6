"""Data quality, completeness and the sentences drawn from them.

META tables have a handful of rows per board, set by the board specification.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf, in_quarter
from tallyboard.functions.deal_rules import is_open
from tallyboard.functions.numbers import money_of_list, money_of_parts, money_parts, money_sum, money_total
from tallyboard.functions.text import labelled, strip
from tallyboard.operators.deals import BY_VALUE, open_deals, top_open_deals
from tallyboard.operators.filters import DashboardFilters, deal_conditions
from tallyboard.operators.shapes import first_of, one_row, with_leaders
from tallyboard.schemas import DEALS_BOARD, WORK_ORDERS_BOARD, BoardSpec

# The six checks, in order.
CHECKS = (
    "missing_close_dates",
    "missing_owners",
    "missing_status",
    "duplicate_deals",
    "invalid_values",
    "missing_columns",
)
# The labels.
HEALTH_LABELS = {"green": "Healthy", "yellow": "Warning", "red": "Critical"}


def _total(condition: Column, alias: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0)).alias(alias)


def _by_share(missing: Column, total: Column, tolerated: float) -> Column:
    share = missing / F.greatest(total, F.lit(1))
    return F.when(missing == 0, "green").when(share <= tolerated, "yellow").otherwise("red")


def _if_any(count: Column) -> Column:
    return F.when(count == 0, "green").otherwise("yellow")


def _by_columns(count: Column) -> Column:
    return F.when(count == 0, "green").when(count <= 2, "yellow").otherwise("red")


def _check_rows(totals: DataFrame, checks: list[tuple[Column, Column, Column | None]]) -> DataFrame:
    nothing = F.array().cast("array<string>")
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            count.cast("long").alias("count"),
            status.alias("status"),
            (nothing if details is None else details).alias("details"),
        )
        for name, (count, status, details) in zip(CHECKS, checks)
    ]
    return totals.select(F.inline(F.array(*rows)))


def _absent_fields(condition: Column, alias: str) -> Column:
    return F.sort_array(F.collect_set(F.when(condition, F.col("field")))).alias(alias)


def meta_totals(deals_meta: DataFrame, work_orders_meta: DataFrame) -> DataFrame:
    """One row of everything the checks read, from both META tables in one aggregate."""
    board, metric, field = F.col("board"), F.col("metric"), F.col("field")
    of_deals, of_orders = board == DEALS_BOARD.board, board == WORK_ORDERS_BOARD.board
    missing, absent = metric == "missing_field", metric == "missing_column"
    return deals_meta.unionByName(work_orders_meta).agg(
        _total(of_deals & (metric == "total_rows"), "total_deals"),
        _total(of_orders & (metric == "total_rows"), "total_orders"),
        _total(of_deals & missing & (field == "expected_close_date"), "missing_dates"),
        _total(of_deals & missing & (field == "owner"), "missing_owners"),
        _total(of_orders & missing & (field == "status"), "missing_status"),
        _total(of_deals & (metric == "dropped_rows"), "duplicates"),
        _total(of_deals & missing & ~field.isin("expected_close_date", "owner", "sector"), "invalid"),
        _total(of_deals & missing & (field == "value"), "missing_values"),
        _total(missing, "missing_fields"),
        _absent_fields(absent, "absent"),
        _absent_fields(absent & of_deals, "absent_deals"),
    )


def data_quality(deals_meta: DataFrame, work_orders_meta: DataFrame) -> DataFrame:
    """Six checks with count, traffic light and details."""
    c = F.col
    return _check_rows(
        meta_totals(deals_meta, work_orders_meta),
        [
            (c("missing_dates"), _by_share(c("missing_dates"), c("total_deals"), 0.3), None),
            (c("missing_owners"), _by_share(c("missing_owners"), c("total_deals"), 0.3), None),
            (c("missing_status"), _by_share(c("missing_status"), c("total_orders"), 0.1), None),
            (c("duplicates"), _if_any(c("duplicates")), None),
            (c("invalid"), _if_any(c("invalid")), None),
            (F.size("absent"), _by_columns(F.size("absent")), c("absent")),
        ],
    )


def _is_blank(column: str) -> Column:
    return F.coalesce(strip(F.col(column)), F.lit("")) == ""


def _filtered_counts(found: Column) -> list[Column]:
    undated = is_open(F.col("stage")) & F.col("expected_close_date").isNull()
    return [
        F.count_if(found).alias("total_deals"),
        F.count_if(found & undated).alias("missing_dates"),
        F.count_if(found & _is_blank("owner")).alias("missing_owners"),
    ]


def _order_counts(work_orders: DataFrame) -> DataFrame:
    return work_orders.agg(F.count(F.lit(1)).alias("total_orders"), F.count_if(_is_blank("status")).alias("missing_status"))


def _filtered_checks(totals: DataFrame) -> DataFrame:
    c = F.col
    return _check_rows(
        totals,
        [
            (c("missing_dates"), _by_share(c("missing_dates"), c("total_deals"), 0.3), None),
            (c("missing_owners"), _by_share(c("missing_owners"), c("total_deals"), 0.3), None),
            (c("missing_status"), _by_share(c("missing_status"), c("total_orders"), 0.1), None),
            (c("duplicates"), _if_any(c("duplicates")), None),
            (F.lit(0), F.lit("green"), None),
            (F.size("absent"), _by_columns(F.size("absent")), c("absent")),
        ],
    )


def data_quality_filtered(deals: DataFrame, work_orders: DataFrame, deals_meta: DataFrame) -> DataFrame:
    """The same checks on filtered rows: undated open deals, blank owners and statuses.

    Denominators are the filtered row counts; duplicates and columns come from the deals META.
    """
    metric = F.col("metric")
    meta = deals_meta.agg(_total(metric == "dropped_rows", "duplicates"), _absent_fields(metric == "missing_column", "absent"))
    return _filtered_checks(one_row(deals.agg(*_filtered_counts(F.lit(True))), _order_counts(work_orders), meta))


def data_quality_filtered_marked(
    marked: DataFrame, filters: DashboardFilters, work_orders: DataFrame, spec: BoardSpec = DEALS_BOARD
) -> DataFrame:
    """``data_quality_filtered`` of the deals with their marks, before the filter: one pass gives counts and META."""
    found = F.coalesce(reduce(Column.__and__, deal_conditions(marked, filters)), F.lit(False))
    titles = F.coalesce(F.col("titles_present"), F.lit(0).cast("long"))
    names = [F.when(titles.bitwiseAND(F.lit(1 << i)) == 0, F.lit(field)) for i, field in enumerate(spec.fields)]
    of_deals = marked.agg(
        *_filtered_counts(found),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.min_by("titles_present", "seq").alias("titles_present"),
    ).withColumn("absent", F.sort_array(F.array_compact(F.array(*names)))).drop("titles_present")
    return _filtered_checks(one_row(of_deals, _order_counts(work_orders)))


def quality_labels(quality: DataFrame) -> DataFrame:
    """Each check with the label its light is shown under."""
    label = F
    for status, text in HEALTH_LABELS.items():
        label = label.when(F.col("status") == status, text)
    return quality.select("check", "status", label.otherwise("Unknown").alias("label"))


def quality_overall(quality: DataFrame) -> DataFrame:
    """Whether every check is green, and the label of the worst one."""
    has = {s: F.bool_or(F.col("status") == s) for s in HEALTH_LABELS}
    worst = F.when(has["red"], HEALTH_LABELS["red"]).when(has["yellow"], HEALTH_LABELS["yellow"])
    return quality.agg(
        F.bool_and(F.col("status") == "green").alias("all_healthy"),
        worst.otherwise(HEALTH_LABELS["green"]).alias("label"),
    )


# The notes.
_NO_SECTOR = "Sector/service analysis unavailable: the %s board does not contain a Sector column."
_ALL_EMPTY = "%s board: all values are empty in '%s' column."
_SOME_EMPTY = "%s board: %d values missing/malformed in '%s' column."
_DROPPED = "%s board: %d duplicate row(s) dropped."
_NO_OWNERS = (
    "No deal owners are currently assigned in the Deals board. "
    "This limits owner-level reporting and accountability analysis."
)
_NO_ASSIGNEES = (
    "No project assignees are currently assigned in the Work Orders board. "
    "This limits resource utilization and accountability analysis."
)


def missing_data_notes(*metas: DataFrame, specs: tuple[BoardSpec, ...] = (DEALS_BOARD, WORK_ORDERS_BOARD)) -> DataFrame:
    """``(rank, board, field, note)``: one sentence per gap, in order; a missing column silences its row notes.

    A board's notes begin with its missing sector column, follow its fields and end with the rows dropped. ``rank``, from 1,
    counts by board in the order of ``specs``.
    """
    meta = metas[0]
    for other in metas[1:]:
        meta = meta.unionByName(other)
    board, metric, field, count = (F.col(c) for c in ("board", "metric", "field", "count"))
    # Places of all notes there can be: a table of fixed size, known before any row is read.
    places = [
        place
        for spec in specs
        for place in [(spec.board, "missing_column", "sector"), *((spec.board, "missing_field", f) for f in spec.fields), (spec.board, "dropped_rows", "")]
    ]
    place = F.create_map(*[x for i, key in enumerate(places) for x in (F.lit("/".join(key)), F.lit(i))])
    per_board = meta.groupBy("board").agg(
        F.max(F.when(metric == "total_rows", count)).alias("total"),
        _absent_fields(metric == "missing_column", "absent"),
        F.collect_list(F.struct(metric, field, count)).alias("entries"),
    )
    entries = per_board.select("board", "total", "absent", F.inline("entries"))
    entries = entries.withColumn("place", F.try_element_at(place, F.concat_ws("/", board, metric, F.coalesce(field, F.lit("")))))
    silenced = F.array_contains("absent", field)
    whole = F.when((board == DEALS_BOARD.board) & (field == "owner"), _NO_OWNERS).when(
        (board == WORK_ORDERS_BOARD.board) & (field == "assigned_to"), _NO_ASSIGNEES
    )
    note = (
        F.when((metric == "missing_column") & (field == "sector"), F.format_string(_NO_SECTOR, board))
        .when(
            (metric == "missing_field") & ~silenced & (count == F.col("total")),
            F.coalesce(whole, F.format_string(_ALL_EMPTY, board, field)),
        )
        .when((metric == "missing_field") & ~silenced, F.format_string(_SOME_EMPTY, board, count, field))
        .when((metric == "dropped_rows") & (count > 0), F.format_string(_DROPPED, board, count))
    )
    noted = entries.select("place", "board", "field", note.alias("note")).filter(F.col("note").isNotNull())
    listed = noted.agg(F.array_sort(F.collect_list(F.struct("place", "board", "field", "note"))).alias("notes"))  # one per place
    ranked = listed.select(F.posexplode("notes").alias("at", "n"))
    return ranked.select((F.col("at") + 1).alias("rank"), "n.board", "n.field", "n.note")


def data_completeness(deals_meta: DataFrame, work_orders_meta: DataFrame) -> DataFrame:
    """Whether no field is missing anywhere on either board."""
    totals = meta_totals(deals_meta, work_orders_meta)
    return totals.select((F.col("missing_fields") == 0).alias("is_complete"))


def value_complete(deals_meta: DataFrame) -> DataFrame:
    """Whether every deal states a value."""
    missing = (F.col("metric") == "missing_field") & (F.col("field") == "value")
    return deals_meta.agg((F.count_if(missing & (F.col("count") > 0)) == 0).alias("is_complete"))


def _confidence(pct_missing: Column) -> Column:
    return F.when(pct_missing == 0, "High").when(pct_missing <= 30, "Medium").otherwise("Low")


def _missing_dates(deals_meta: DataFrame) -> DataFrame:
    unparsed = (F.col("metric") == "missing_field") & (F.col("field") == "expected_close_date")
    return deals_meta.agg(_total(unparsed, "missing_dates"))


def forecast_confidence(deals: DataFrame, deals_meta: DataFrame) -> DataFrame:
    """Unparseable close dates against open deals."""
    open_count = deals.agg(F.count_if(is_open(F.col("stage"))).alias("deal_count"))
    pct = F.col("missing_dates") / F.greatest(F.col("deal_count"), F.lit(1)) * 100
    return one_row(open_count, _missing_dates(deals_meta)).select(
        _confidence(pct).alias("confidence"), F.round(pct, 6).alias("pct_missing")
    )


def _unparsed_dates(spec: BoardSpec) -> Column:
    """Whether a marked row has a close date that could not be read."""
    return F.col("missing").bitwiseAND(F.lit(1 << spec.fields.index("expected_close_date"))) != 0


def forecast_confidence_marked(marked: DataFrame, spec: BoardSpec = DEALS_BOARD) -> DataFrame:
    """``forecast_confidence`` of the deals with their marks, in one pass."""
    totals = marked.agg(F.count_if(is_open(F.col("stage"))).alias("deal_count"), F.count_if(_unparsed_dates(spec)).alias("missing_dates"))
    pct = F.col("missing_dates") / F.greatest(F.col("deal_count"), F.lit(1)) * 100
    return totals.select(_confidence(pct).alias("confidence"), F.round(pct, 6).alias("pct_missing"))


def forecast_confidence_filtered(deals: DataFrame) -> DataFrame:
    """Undated open deals against all filtered deals."""
    undated = is_open(F.col("stage")) & F.col("expected_close_date").isNull()
    counts = deals.agg(F.count(F.lit(1)).alias("total"), F.count_if(undated).alias("undated"))
    pct = F.when(F.col("total") > 0, F.col("undated") / F.col("total") * 100).otherwise(0.0)
    return counts.select(_confidence(pct).alias("confidence"), F.round(pct, 6).alias("pct_missing"))


def stage_rollup(deals: DataFrame, as_of: AsOf) -> DataFrame:
    """Open deals by stage, a missing stage included: all that the sentences add up."""
    day = F.col("expected_close_date")
    return (
        open_deals(deals)
        .groupBy("stage")
        .agg(
            money_sum(F.col("value")).alias("value"),
            F.count(F.lit(1)).alias("deal_count"),
            F.count_if(in_quarter(day, as_of)).alias("quarter_count"),
            F.count_if(day.isNull()).alias("undated"),
        )
    )


def _led(stages: DataFrame, *others: Column) -> DataFrame:
    """One row: open totals and the leading stage, beside ``others``.

    On equal values the first stage by name leads, as in the sorted breakdown.
    """
    stage, value = F.col("stage"), F.round("value", 2).cast("double")
    leader = F.when(stage.isNotNull() & (F.col("deal_count") > 0), F.struct((-value).alias("negated"), stage))
    totals = stages.agg(
        money_total(F.col("value")).alias("total_value"),
        F.coalesce(F.sum("deal_count"), F.lit(0)).alias("deal_count"),
        F.coalesce(F.sum("quarter_count"), F.lit(0)).alias("quarter_count"),
        F.coalesce(F.sum("undated"), F.lit(0)).alias("undated"),
        F.min(leader).alias("leader"),
        *others,
    )
    return totals.withColumns({"top_stage": F.col("leader.stage"), "top_stage_value": -F.col("leader.negated")}).drop("leader")


def _sentence_totals(stages: DataFrame, top: DataFrame) -> DataFrame:
    """``_led`` and the value of the five largest deals."""
    largest = top.orderBy(F.col("value").desc(), "id").limit(5)
    held = largest.agg(money_total(F.col("value")).alias("top5_value"), F.count(F.lit(1)).alias("top5_count"))
    return one_row(_led(stages), held)


def _sentence_totals_at_once(deals: DataFrame, as_of: AsOf, unparsed: Column) -> DataFrame:
    """``_sentence_totals`` with ``all_deals`` and ``missing_dates``, from one pass over all deals, open or not."""
    is_due, day = is_open(F.col("stage")), F.col("expected_close_date")
    rows = deals.select("id", "stage", is_due.alias("is_due"), F.when(is_due, F.col("value")).alias("value"), day, unparsed.alias("unparsed"))
    due, counted = F.col("is_due"), ("deal_count", "quarter_count", "undated", "all_deals", "missing_dates")
    conditions = (due, due & in_quarter(day, as_of), due & day.isNull(), F.lit(True), F.col("unparsed"))
    stages = with_leaders(
        rows, [due.desc(), F.col("value").desc(), F.col("id")], F.when(due, F.struct("value", "id")), 5,
        money_parts(F.col("value")) | {name: F.count_if(which) for name, which in zip(counted, conditions)},
        {"value": money_of_parts()} | {name: F.sum(name) for name in counted}, "stage",
    )
    stages = stages.withColumn("leaders", first_of(F.col("leaders"), 5, *BY_VALUE))
    totals = _led(
        stages, *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counted[3:]],
        F.flatten(F.collect_list("leaders")).alias("leaders"),
    )
    top = F.transform(first_of(F.col("leaders"), 5, *BY_VALUE), lambda deal: deal["value"])
    return totals.withColumns({"top5_value": money_of_list(top), "top5_count": F.size(top)}).drop("leaders")


def _numbered(totals: DataFrame, sentences: list[Column]) -> DataFrame:
    """Sentences that apply, numbered in order; the list is fixed and short."""
    given = totals.select(F.posexplode(F.array_compact(F.array(*sentences))).alias("rank", "insight"))
    return given.select((F.col("rank") + 1).alias("rank"), "insight")


def insights(deals: DataFrame, deals_meta: DataFrame, as_of: AsOf) -> DataFrame:
    """Up to five sentences on concentration, leading stage, quarter, dates and confidence."""
    return insights_from(stage_rollup(deals, as_of), top_open_deals(deals, 5), deals_meta)


def insights_from(stages: DataFrame, top: DataFrame, deals_meta: DataFrame) -> DataFrame:
    """``insights`` from open deals by stage and the largest open deals."""
    return _insight_rows(one_row(_sentence_totals(stages, top), _missing_dates(deals_meta)))


def insights_marked(marked: DataFrame, as_of: AsOf, spec: BoardSpec = DEALS_BOARD) -> DataFrame:
    """``insights`` of the deals with their marks, in one pass."""
    return _insight_rows(_sentence_totals_at_once(marked, as_of, _unparsed_dates(spec)))


# The sentences below are fixed values.


def _insight_rows(totals: DataFrame) -> DataFrame:
    c = F.col
    share = c("top5_value") / F.greatest(c("total_value"), F.lit(1.0)) * 100
    pct_missing = c("missing_dates") / F.greatest(c("deal_count"), F.lit(1)) * 100
    return _numbered(
        totals,
        [
            F.when(
                (c("top5_count") > 0) & (share >= 50),
                F.format_string("Pipeline heavily concentrated in top 5 opportunities (%.1f%% of total value).", share),
            ),
            F.when(
                c("top_stage").isNotNull(),
                F.format_string(
                    "Most active pipeline value sits in '%s' stage ($%,.2f).", c("top_stage"), c("top_stage_value")
                ),
            ),
            F.when(
                c("quarter_count") <= 5,
                F.format_string(
                    "Only %d opportunities are forecast to close in the current quarter.", c("quarter_count")
                ),
            ).otherwise(
                F.format_string("%d opportunities are expected to close this quarter.", c("quarter_count"))
            ),
            F.when(
                c("missing_dates") > 0,
                F.format_string(
                    "%d open opportunities have no expected close date, reducing forecast accuracy.",
                    c("missing_dates"),
                ),
            ),
            F.format_string("Revenue forecast confidence: %s.", _confidence(pct_missing)),
        ],
    )


def insights_filtered(deals: DataFrame, as_of: AsOf) -> DataFrame:
    """The browser's sentences and thresholds, on filtered deals in one pass; deals without a stage count as a stage."""
    staged = deals.withColumn("stage", labelled(F.col("stage"), "Unknown"))
    return _filtered_insight_rows(_sentence_totals_at_once(staged, as_of, F.lit(False)))


def insights_filtered_from(stages: DataFrame, top: DataFrame, counted: DataFrame) -> DataFrame:
    """``insights_filtered`` from open deals by stage, the largest ones and the ``all_deals`` count."""
    return _filtered_insight_rows(one_row(_sentence_totals(stages, top), counted))


def _filtered_insight_rows(totals: DataFrame) -> DataFrame:
    c = F.col
    base = F.greatest(c("total_value"), F.lit(1.0))
    stage_share, share = c("top_stage_value") / base * 100, c("top5_value") / base * 100
    pct_missing = F.when(c("all_deals") > 0, c("undated") / c("all_deals") * 100).otherwise(0.0)
    return _numbered(
        totals,
        [
            F.when(
                stage_share > 40,
                F.format_string(
                    "Most active pipeline value sits in '%s' stage (%.0f%% of total).", c("top_stage"), stage_share
                ),
            ),
            F.format_string(
                "Only %d opportunities are expected to close this quarter, limiting near-term volume.",
                c("quarter_count"),
            ),
            F.when(
                c("undated") > 0,
                F.format_string(
                    "%d opportunities have no close date, lowering Q3/Q4 forecasting accuracy.", c("undated")
                ),
            ),
            F.when(
                (c("top5_count") > 0) & (share > 50),
                F.format_string(
                    "Pipeline heavily concentrated in top 5 opportunities (%.0f%% of total active value).", share
                ),
            ),
            F.format_string("Revenue forecast confidence: %s.", _confidence(pct_missing)),
        ],
    )
