"""Scalar rules against Python's and pandas' own behaviour and against listed values."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyboard.functions import dates, deal_rules, numbers, text, work_rules


def evaluate(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("v"))).collect()]


def test_strip_removes_what_python_removes(spark):
    values = ["  a b ", "\t x\n", " y　", "\x1cz\x1f", "é", " é ", "", "   ", None, "a"]
    assert evaluate(spark, text.strip, values) == [None if v is None else v.strip() for v in values]


def test_normalize_text_blanks_to_null(spark):
    assert evaluate(spark, text.normalize_text, ["", "  ", " ", " a ", None]) == [None, None, None, "a", None]


def test_title_case_matches_python(spark):
    values = [
        "l&t corridor", "O'NEIL", "3rd party", "proposal/commercials sent", "i. poc", "éCOLE d'été", "a_b-c",
        "日本abc", "executed until current month", "", None, "x2y", "MIXED case",
    ]
    assert evaluate(spark, text.title_case, values) == [None if v is None else v.title() for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=126)), min_size=1, max_size=60))
def test_title_case_matches_python_on_any_ascii(spark, values):
    assert evaluate(spark, text.title_case, values) == [v.title() for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=60))
def test_strip_matches_python_on_any_text(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert evaluate(spark, text.strip, values) == [v.strip() for v in values]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (
            text.clean_sector,
            {"agri": "Agriculture", "AGRO": "Agriculture", "infra": "Infrastructure", " construction ": "Infrastructure",
             "Power": "Energy", "renewables": "Energy", "mining": "Mining", "": None, "oil & gas": "Oil & Gas"},
        ),
        (
            text.clean_stage,
            {"won": "Won", "Won Deal": "Won", "CLOSED WON": "Won", "lost": "Lost", "closed lost": "Lost",
             "g. project won": "G. Project Won", "i. POC": "I. Poc", " ": None},
        ),
        (
            text.clean_status,
            {"in progress": "In Progress", "INPROGRESS": "In Progress", "active": "In Progress", "backlog": "Not Started",
             "notstarted": "Not Started", "overdue": "Delayed", "blocked": "Delayed", "DONE": "Done", "": None},
        ),
        (
            work_rules.delivery_category,
            {"Done": "Completed", "complete": "Completed", "Executed Until Current Month": "In Progress",
             "blocked": "Delayed", " stopped ": "Cancelled", "Canceled": "Cancelled", "Not Started": "Pending", "?": "Pending"},
        ),
    ],
)
def test_category_cleaners(spark, rule, cases):
    assert evaluate(spark, rule, list(cases)) == list(cases.values())


def test_missing_status_is_pending(spark):
    assert evaluate(spark, work_rules.delivery_category, [None]) == ["Pending"]


DATE_TEXTS = [
    "2026-07-15", "2026-7-5", "2026/07/15", "2026.07.15", "15/07/2026", "05/06/2026", "25-07-2026", "05-07-2026",
    "15.07.2026", "07/15/2026", "20260715", "Jul 15, 2026", "July 15, 2026", "15 Jul 2026", "15 July 2026", "July 2026",
    "May 2026", "Jul 15 2026", "15-Jul-2026", "2026-07", "2026", "15/07/26", "15-07-26", "07/15/99", "2026-02-30",
    "31/04/2026", "13/13/2026", "tbd", "soon", "2026-07-15T10:30:00", "2026-07-15 10:30", "2026-07-15T23:00:00Z",
    "Sept 3, 2026", "3rd Jul 2026", "Foo 3, 2026", "not a date", "15-Jul-26", "15 Jul 26", "Jul 15 26", "07/2026", "7/2026",
    "7/15/2026 3:00 PM", "2026-07-15 3:00 PM", "Wed, 15 Jul 2026", "Wednesday, July 15, 2026", "15/Jul/2026", "2026-Jul-15",
    "2026 Jul 15", "20260715 10:30", "20260715T103000", "2026-07-15 10:30:00 UTC", "2026-07-15T10", "2026-Q3", "2026Q1",
    "9999-12-31", "2300-01-01", "1500-01-01", "2262-04-11", "1677-09-22", "15-Jul-75",
]


def test_parse_date_matches_pandas(spark):
    expected = []
    for value in DATE_TEXTS:
        parsed = pd.to_datetime(value, errors="coerce")
        expected.append(None if pd.isna(parsed) else parsed.date())
    actual = evaluate(spark, dates.parse_date, DATE_TEXTS)
    assert dict(zip(DATE_TEXTS, actual)) == dict(zip(DATE_TEXTS, expected))


def test_short_years_lie_around_as_of(spark):
    texts = ["01/02/49", "01/02/50", "3 May 99", "01/02/00"]
    around_2000 = evaluate(spark, lambda c: dates.parse_date(c, "2000-07-27"), texts)
    assert [d.year for d in around_2000] == [2049, 1950, 1999, 2000]
    assert [d.year for d in evaluate(spark, lambda c: dates.parse_date(c, dt.date(2060, 1, 1)), texts)] == [2049, 2050, 2099, 2100]


def test_money_sums_never_fail_and_never_drop(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 1e22), ("b", float("inf")), ("b", 1.0), ("c", None)], "k string, v double")
    shown = {r.k: (r.t, r.s) for r in rows.groupBy("k").agg(numbers.money_total(F.col("v")).alias("t"), numbers.money_sum(F.col("v")).alias("s")).collect()}
    assert shown == {"a": (1e22, 1e22), "b": (float("inf"),) * 2, "c": (0.0, 0.0)}
    texts = ["9" * 23, "9" * 400, "12.345"]
    assert evaluate(spark, numbers.parse_number, texts) == [float("9" * 23), float("inf"), 12.345]
    assert rows.filter("v < 1").agg(numbers.money_total(F.col("v"))).first()[0] == 0.3


def test_parse_date_rejects_numbers_and_relative_words(spark):
    assert evaluate(spark, dates.parse_date, ["45000", "now", "today", "", None]) == [None] * 5


def test_parse_number(spark):
    cases = {
        "150000": 150000.0, "1,234.56": 1234.56, "$1.2M": 1.2, "-5": 5.0, "-5.5": -5.5, "1e3": 1.0, "12.": 12.0, "70%": 70.0,
        ".5": 0.5, "abc": 0.0, "": 0.0, None: 0.0, "USD 1,000 - 2,000": 1000.0, "+7.25": 7.25,
    }
    assert evaluate(spark, numbers.parse_number, list(cases)) == list(cases.values())


def test_weights_and_buckets(spark):
    rows = [
        (100.0, None, "Lead"), (100.0, 0.0, "Proposal"), (100.0, 0.5, "Lead"), (100.0, 1.0, "Lead"), (100.0, 55.0, "Lead"),
        (100.0, 0.0, "Unheard Of"), (100.0, 0.0, "L. Project Lost"), (100.0, 0.0, None), (100.0, 0.0, "G. Project Won"),
    ]
    frame = spark.createDataFrame(rows, "value double, probability double, stage string").repartition(1)
    v, p, s = F.col("value"), F.col("probability"), F.col("stage")
    shown = frame.select(
        deal_rules.weighted_value(v, p, s),
        deal_rules.weighted_value_raw(v, p),
        deal_rules.weighted_value_interactive(v, p, s),
        deal_rules.probability_bucket(deal_rules.probability_pct(p, s)),
        deal_rules.probability_bucket(deal_rules.probability_pct_interactive(p, s)),
        deal_rules.is_open(s),
    ).collect()
    assert [tuple(r) for r in shown] == [
        (10.0, None, 10.0, "0-20%", "0-20%", True),
        (60.0, 0.0, 60.0, "40-60%", "40-60%", True),
        (50.0, 50.0, 50.0, "40-60%", "40-60%", True),
        (100.0, 100.0, 100.0, "80-100%", "80-100%", True),
        (55.00000000000001, 55.00000000000001, 55.00000000000001, "40-60%", "40-60%", True),
        (20.0, 0.0, 20.0, "0-20%", "0-20%", True),
        (0.0, 0.0, 20.0, "0-20%", "0-20%", True),
        (20.0, 0.0, 20.0, "0-20%", "0-20%", True),
        (100.0, 0.0, 100.0, "80-100%", "80-100%", True),
    ]


def test_quarter_bounds(spark):
    days = [dt.date(2026, 6, 30), dt.date(2026, 7, 1), dt.date(2026, 9, 30), dt.date(2026, 10, 1), None]
    frame = spark.createDataFrame([(d,) for d in days], "d date").repartition(1)
    inside = [r[0] for r in frame.select(dates.in_quarter(F.col("d"), "2026-07-27")).collect()]
    assert inside == [False, True, True, False, None]
