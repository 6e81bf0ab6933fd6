"""Hand-derived results on the small boards."""

from __future__ import annotations

import datetime as dt

import pytest

import golden
from tallyboard.operators import both_boards, cleaning, deals, quality, work_orders
from tallyboard.operators.filters import DashboardFilters, filter_deals, filter_work_orders
from tallyboard.plans.dashboard import dashboard, dashboard_kpis, filtered_dashboard
from tallyboard.plans.leadership import leadership_summary
from tallyboard.schemas import DEALS, DEALS_BOARD, WORK_ORDERS, WORK_ORDERS_BOARD, WORK_ORDERS_BOARD_START_DATE

AS_OF = golden.AS_OF


@pytest.fixture(scope="module")
def deals_board(spark):
    return cleaning.clean_board(golden.deal_items(spark), DEALS_BOARD)


@pytest.fixture(scope="module")
def orders_board(spark):
    return cleaning.clean_board(golden.order_items(spark), WORK_ORDERS_BOARD)


def tuples(frame):
    return [tuple(r) for r in frame.collect()]


def meta_of(frame):
    return {(r.metric, r.field): r["count"] for r in frame.collect()}


def test_schemas(deals_board, orders_board):
    assert deals_board.rows.dtypes == [(f.name, f.dataType.simpleString()) for f in DEALS]
    assert sorted(orders_board.rows.dtypes) == sorted((f.name, f.dataType.simpleString()) for f in WORK_ORDERS)


def test_clean_deals(deals_board):
    rows = {r.id: r for r in deals_board.rows.collect()}
    assert len(rows) == 9
    untidy = rows["d9"]
    assert (untidy.sector, untidy.stage, untidy.value, untidy.probability) == ("Mining", "Won", 150000.0, 100.0)
    assert untidy.expected_close_date == dt.date(2026, 7, 15)
    empty = rows["d10"]
    assert (empty.sector, empty.value, empty.probability, empty.expected_close_date) == (None, 0.0, 0.0, None)


def test_clean_work_orders(spark):
    board = cleaning.clean_board(golden.order_items(spark), WORK_ORDERS_BOARD_START_DATE)
    untidy = board.rows.filter("id = 'w6'").first()
    assert (untidy.status, untidy.sector) == ("In Progress", "Energy")
    assert (untidy.start_date, untidy.due_date) == (dt.date(2026, 6, 15), dt.date(2026, 7, 25))
    assert meta_of(board.meta) == {("total_rows", None): 6, ("dropped_rows", None): 0}


def test_meta(deals_board, orders_board):
    assert meta_of(deals_board.meta) == {
        ("total_rows", None): 10, ("dropped_rows", None): 1, ("missing_field", "sector"): 1
    }
    assert meta_of(orders_board.meta) == {
        ("total_rows", None): 6, ("dropped_rows", None): 0, ("missing_column", "start_date"): 1
    }


def test_pipeline(deals_board):
    rows = deals_board.rows
    assert tuples(deals.pipeline_health(rows, AS_OF)) == [(720000.0, 485000.0, 5, 720000.0, 4, 1)]
    assert tuples(deals.pipeline_stage(rows)) == [
        ("Proposal", 370000.0, 3), ("Negotiation", 300000.0, 1), ("Lead", 50000.0, 1)
    ]
    assert tuples(deals.opportunity_distribution(rows)) == [("Open", 5), ("Won", 4), ("Lost", 0)]
    assert [r.name for r in deals.top_deals(rows).collect()] == [f"Item {i}" for i in ("d4", "d3", "d6", "d5", "d10")]
    assert dict(tuples(deals.closure_probability(rows))) == {
        "0-20%": 1, "20-40%": 0, "40-60%": 2, "60-80%": 2, "80-100%": 0
    }
    assert set(tuples(deals.deals_by_owner(rows))) == {
        ("Alice", 120000.0, 1), ("Bob", 550000.0, 3), ("Charlie", 50000.0, 1)
    }


def test_revenue(deals_board):
    rows = deals_board.rows
    assert tuples(deals.revenue_total(rows)) == [(680000.0, 4)]
    assert dict(tuples(deals.revenue_by_sector(rows))) == {"Mining": 300000.0, "Energy": 180000.0, "Infrastructure": 200000.0}
    assert dict(tuples(deals.revenue_by_month(rows))) == {"2026-06": 200000.0, "2026-07": 480000.0}


def test_forecasts(deals_board):
    near = {("2026-07", 300000.0, 240000.0, 1), ("2026-08", 370000.0, 235000.0, 2), ("2026-09", 50000.0, 10000.0, 1)}
    assert set(tuples(deals.monthly_forecast(deals_board.rows))) == near | {("Missing Date", 0.0, 0.0, 1)}
    far = {(f"2026-{m}", 0.0, 0.0, 0) for m in (10, 11, 12)}
    assert set(tuples(deals.revenue_forecast(deals_board.rows, AS_OF))) == near | far


def test_delays(orders_board):
    rows = orders_board.rows
    assert sorted(r.id for r in work_orders.delayed_items(rows, AS_OF).collect()) == ["w2", "w3", "w6"]
    assert dict(tuples(work_orders.delayed_by_sector(rows, AS_OF))) == {"Energy": 2, "Infrastructure": 1}
    assert dict(tuples(work_orders.delayed_by_assignee(rows, AS_OF))) == {"Eve": 2, "Dave": 1}
    assert dict(tuples(work_orders.work_order_status(rows))) == {
        "Completed": 2, "In Progress": 2, "Pending": 1, "Delayed": 1, "Cancelled": 0
    }
    assert set(tuples(work_orders.work_orders_by_assignee(rows))) == {("Dave", 2, 1), ("Eve", 3, 0), ("Frank", 1, 0)}


def test_both_boards(deals_board, orders_board):
    d, w = deals_board.rows, orders_board.rows
    assert set(tuples(both_boards.sector_analysis(d, w, AS_OF))) == {
        ("Mining", 720000.0, 300000.0, 420000.0, 4, 2, 1, 1, 0, 0),
        ("Energy", 180000.0, 180000.0, 0.0, 1, 1, 2, 0, 2, 2),
        ("Infrastructure", 450000.0, 200000.0, 250000.0, 2, 1, 2, 1, 1, 0),
        ("Agriculture", 50000.0, 0.0, 50000.0, 1, 0, 1, 0, 0, 0),
    }
    assert tuples(both_boards.business_overview(d, w, AS_OF)) == [
        (680000.0, 4, 720000.0, 485000.0, 5, 6, 2, 3, 4, 0.5)
    ]
    assert tuples(both_boards.pipeline_vs_work_orders(d, w, AS_OF)) == [(5, 720000.0, 2, 1, 2.5)]
    assert tuples(both_boards.general_business_health(d, w, AS_OF)) == [(680000.0, 720000.0, 2, 1)]


def test_quality(deals_board, orders_board):
    checks = {r.check: (r["count"], r.status, r.details) for r in quality.data_quality(deals_board.meta, orders_board.meta).collect()}
    assert checks == {
        "missing_close_dates": (0, "green", []),
        "missing_owners": (0, "green", []),
        "missing_status": (0, "green", []),
        "duplicate_deals": (1, "yellow", []),
        "invalid_values": (0, "green", []),
        "missing_columns": (1, "yellow", ["start_date"]),
    }
    notes = {r.note for r in quality.missing_data_notes(deals_board.meta, orders_board.meta).collect()}
    assert notes == {"Deals board: 1 values missing/malformed in 'sector' column.", "Deals board: 1 duplicate row(s) dropped."}
    assert tuples(quality.value_complete(deals_board.meta)) == [(True,)]
    assert tuples(quality.data_completeness(deals_board.meta, orders_board.meta)) == [(False,)]
    assert tuples(quality.forecast_confidence(deals_board.rows, deals_board.meta)) == [("High", 0.0)]


GOLDEN_INSIGHTS = [
    "Pipeline heavily concentrated in top 5 opportunities (100.0% of total value).",
    "Most active pipeline value sits in 'Proposal' stage ($370,000.00).",
    "Only 4 opportunities are forecast to close in the current quarter.",
    "Revenue forecast confidence: High.",
]


def test_insights(deals_board):
    found = quality.insights(deals_board.rows, deals_board.meta, AS_OF).orderBy("rank")
    assert [r.insight for r in found.collect()] == GOLDEN_INSIGHTS
    browser = quality.insights_filtered(deals_board.rows, AS_OF).orderBy("rank")
    assert [r.insight for r in browser.collect()] == [
        "Most active pipeline value sits in 'Proposal' stage (51% of total).",
        "Only 4 opportunities are expected to close this quarter, limiting near-term volume.",
        "1 opportunities have no close date, lowering Q3/Q4 forecasting accuracy.",
        "Pipeline heavily concentrated in top 5 opportunities (100% of total active value).",
        "Revenue forecast confidence: Medium.",
    ]


def test_kpis(deals_board, orders_board):
    rows = tuples(dashboard_kpis(deals_board.rows, orders_board.rows, AS_OF))
    assert [(kpi, value) for kpi, value, _ in rows] == [
        ("total_pipeline", 720000.0), ("weighted_pipeline", 485000.0), ("open_opportunities", 5.0),
        ("current_quarter_pipeline", 720000.0), ("completed_work_orders", 2.0), ("delayed_work_orders", 1.0),
    ]
    assert rows[3][2] == "Forecasted to close in Q3 (4 deals)"


def test_reports_agree_with_operators(deals_board, orders_board):
    d, w = deals_board, orders_board
    report = dashboard(d.rows, w.rows, d.meta, w.meta, AS_OF)
    by_section = {}
    for r in report.collect():
        by_section.setdefault(r.section, []).append(r)
    assert [r.detail for r in sorted(by_section["insights"], key=lambda r: r.key)] == GOLDEN_INSIGHTS
    assert {(r.key, r.value) for r in by_section["pipeline_stage"] if r.metric == "value"} == {
        ("Proposal", 370000.0), ("Negotiation", 300000.0), ("Lead", 50000.0)
    }
    assert {(r.key, r.value) for r in by_section["work_orders"]} == {
        (r.status, float(r["count"])) for r in work_orders.work_order_status(w.rows).collect()
    }
    browser = filtered_dashboard(d.rows, w.rows, d.meta, DashboardFilters(), AS_OF)
    kpis = {r.key: r.value for r in browser.filter("section = 'kpis'").collect()}
    assert kpis["total_pipeline"] == 720000.0 and kpis["weighted_pipeline"] == 485000.0
    assert kpis["delayed_work_orders"] == 3.0
    summary = leadership_summary(d.rows, w.rows, d.meta, w.meta, AS_OF)
    overview = {r.metric: r.value for r in summary.filter("section = 'business_overview'").collect()}
    assert overview["delay_rate"] == 0.5 and overview["total_revenue"] == 680000.0
    late = {r.key for r in summary.filter("section = 'delayed_items'").collect()}
    assert late == {"w2", "w3", "w6"}


def test_filters(deals_board, orders_board):
    def ids(frame):
        return sorted(r.id for r in frame.collect())

    d, w = deals_board.rows, orders_board.rows
    assert ids(filter_deals(d, DashboardFilters(owner="Bob"))) == ["d10", "d3", "d4"]
    assert ids(filter_deals(d, DashboardFilters(search="ITEM D1"))) == ["d1", "d10"]
    assert ids(filter_deals(d, DashboardFilters(deal_stage="Proposal", min_probability=55))) == ["d10", "d3"]
    assert ids(filter_deals(d, DashboardFilters(start_date="2026-08-01"))) == ["d3", "d5", "d6"]
    assert ids(filter_work_orders(w, DashboardFilters(owner="Eve", wo_status="In Progress"))) == ["w2", "w6"]
    assert ids(filter_work_orders(w, DashboardFilters(end_date="2026-06-20"))) == ["w1", "w5"]


def test_empty_boards(spark):
    d = cleaning.clean_board(golden.deal_items(spark).filter("false"), DEALS_BOARD)
    w = cleaning.clean_board(golden.order_items(spark).filter("false"), WORK_ORDERS_BOARD)
    assert tuples(deals.pipeline_health(d.rows, AS_OF)) == [(0.0, 0.0, 0, 0.0, 0, 0)]
    assert tuples(both_boards.business_overview(d.rows, w.rows, AS_OF)) == [(0.0, 0, 0.0, 0.0, 0, 0, 0, 0, 0, 0.0)]
    assert meta_of(d.meta)[("total_rows", None)] == 0
    assert deals.pipeline_stage(d.rows).count() == 0
    assert sum(r["count"] for r in work_orders.work_order_status(w.rows).collect()) == 0
    assert [r.insight for r in quality.insights(d.rows, d.meta, AS_OF).collect()] == [
        "Only 0 opportunities are forecast to close in the current quarter.",
        "Revenue forecast confidence: High.",
    ]
    report = dashboard(d.rows, w.rows, d.meta, w.meta, AS_OF)
    assert {r.value for r in report.filter("section = 'kpis'").collect()} == {0.0}


def test_columns_that_are_all_empty(spark):
    rows = tuple((f"x{i}", "", "Lead", None, "", "when it suits", "") for i in range(3))
    board = cleaning.clean_board(golden.items_of(spark, golden.DEAL_TITLES, rows), DEALS_BOARD)
    assert meta_of(board.meta) == {
        ("total_rows", None): 3, ("dropped_rows", None): 0, ("missing_field", "sector"): 3, ("missing_field", "value"): 3,
        ("missing_field", "expected_close_date"): 3, ("missing_field", "owner"): 3,
    }
    notes = {r.note for r in quality.missing_data_notes(board.meta).collect()}
    assert "Deals board: all values are empty in 'sector' column." in notes
    assert any(n.startswith("No deal owners are currently assigned") for n in notes)


def test_column_without_a_title_silences_its_notes(spark):
    rows = (("x1", "Lead", "10"), ("x2", "Won", "20"))
    board = cleaning.clean_board(golden.items_of(spark, ("Stage", "Value"), rows), DEALS_BOARD)
    notes = {(r.field, r.note) for r in quality.missing_data_notes(board.meta).collect()}
    assert notes == {
        ("sector", "Sector/service analysis unavailable: the Deals board does not contain a Sector column.")
    }
