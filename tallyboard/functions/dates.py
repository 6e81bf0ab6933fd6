"""Date rules: free-text parsing, the quarter of a day, month labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard.functions.text import literal_map

AsOf = str | dt.date

# The spellings of a date.
_TIME = r"([T ]\d{1,2}(:\d{2}(:\d{2}(\.\d+)?)?)?( ?[AaPp][Mm])?( ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?)?"
_YEAR_FIRST = r"^\d{4}([-/.]\d{1,2}([-/.]\d{1,2}" + _TIME + ")?)?$"
_YEAR_LAST = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME + "$"
_SHORT_YEAR = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2})" + _TIME + "$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})([T ]\d{2}:?\d{2}(:?\d{2})?)?$"
_MONTH_YEAR = r"^(\d{1,2})[-/](\d{4})$"
_QUARTER = r"^(\d{4})-?Q([1-4])$"
_WEEKDAY = r"^(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*,? +"
_NAME = r"([A-Za-z]{3,9})\.?"
_NAME_FIRST = r"^" + _NAME + r"[ -](\d{1,2})(?:st|nd|rd|th)?(?:, ?|[ -])(\d{4}|\d{2})" + _TIME + "$"
_NAME_SECOND = r"^(\d{1,2})(?:st|nd|rd|th)?[ /-]" + _NAME + r"(?:, ?|[ /-])(\d{4}|\d{2})" + _TIME + "$"
_NAME_THIRD = r"^(\d{4})[ /-]" + _NAME + r"[ /-](\d{1,2})" + _TIME + "$"
_NAME_YEAR = r"^" + _NAME + r"(?:, ?|[ -])(\d{4})$"

# The first and last whole day that count as dates.
FIRST_DAY, LAST_DAY = "1677-09-22", "2262-04-11"

# Month names; three letters or the whole name, September also with four.
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)
_MONTH_NUMBERS = {"sept": "9"} | {
    name: str(number) for number, month in enumerate(MONTHS, 1) for name in (month[:3], month)
}

# Two-digit years lie within fifty years of this day where no other is given.
SHORT_YEARS_AROUND = "2026-07-27"


def as_of_date(as_of: AsOf) -> Column:
    return F.lit(str(as_of)).cast("date")


def parse_date(text: Column, as_of: AsOf = SHORT_YEARS_AROUND) -> Column:
    """Stripped text to DATE: month first where both readings work, day first where only that does.

    Text that is no date, or one outside of `FIRST_DAY` to `LAST_DAY`, gives null; so do relative words, a month and a day
    without a year, and bare numbers of five digits. Two-digit years lie within fifty years of ``as_of``. The shape is matched
    before anything is cast, so that bad text raises no error row by row. The rarer spellings sit in a lambda: it stays out of
    the generated method, which the JVM would otherwise run uncompiled for its size.
    """
    month_first = F.regexp_replace(text, _YEAR_LAST, "$4-$1-$3").try_cast("date")
    day_first = F.regexp_replace(text, _YEAR_LAST, "$4-$3-$1").try_cast("date")
    rare = F.transform(F.array(F.regexp_replace(text, _WEEKDAY, "")), lambda bare: _parse_rare_date(bare, as_of))
    day = (
        F.when(text.rlike(_YEAR_FIRST), F.translate(text, "/.", "--").try_cast("date"))
        .when(text.rlike(_YEAR_LAST), F.coalesce(month_first, day_first))
        .when(text != "", F.get(rare, F.lit(0)))
    )
    # A single pass over one element, so that the day is worked out once for both bounds.
    inside = F.filter(F.array(day), lambda d: d.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")))
    return F.get(inside, F.lit(0))


def _parse_rare_date(text: Column, as_of: AsOf) -> Column:
    """Compact dates, quarters, two-digit years and month names."""
    now = int(str(as_of)[:4])
    dash = F.lit("-")

    def whole_year(written: Column) -> Column:
        near = written.try_cast("int") + now // 100 * 100
        near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        return F.when(F.length(written) == 2, near.cast("string")).otherwise(written)

    def short(month: int, day: int) -> Column:
        part = [F.regexp_extract(text, _SHORT_YEAR, i) for i in (4, month, day)]
        return F.concat(whole_year(part[0]), dash, part[1], dash, part[2]).try_cast("date")

    numbers = literal_map(_MONTH_NUMBERS)

    def named(pattern: str, year: int, name: int, day: int | None) -> Column:
        month = F.try_element_at(numbers, F.lower(F.regexp_extract(text, pattern, name)))
        day_text = F.regexp_extract(text, pattern, day) if day else F.lit("1")
        return F.concat(whole_year(F.regexp_extract(text, pattern, year)), dash, month, dash, day_text).try_cast("date")

    quarter = F.regexp_extract(text, _QUARTER, 2).try_cast("int") * 3 - 2
    return (
        F.when(text.rlike(_COMPACT), F.regexp_replace(text, _COMPACT, "$1-$2-$3").try_cast("date"))
        .when(text.rlike(_SHORT_YEAR), F.coalesce(short(1, 3), short(3, 1)))
        .when(text.rlike(_NAME_FIRST), named(_NAME_FIRST, year=3, name=1, day=2))
        .when(text.rlike(_NAME_SECOND), named(_NAME_SECOND, year=3, name=2, day=1))
        .when(text.rlike(_NAME_THIRD), named(_NAME_THIRD, year=1, name=2, day=3))
        .when(text.rlike(_NAME_YEAR), named(_NAME_YEAR, year=2, name=1, day=None))
        .when(text.rlike(_MONTH_YEAR), F.regexp_replace(text, _MONTH_YEAR, "$2-$1-1").try_cast("date"))
        .when(text.rlike(_QUARTER), F.concat(F.substring(text, 1, 4), dash, quarter.cast("string"), F.lit("-1")).try_cast("date"))
    )


def quarter_start(as_of: AsOf) -> Column:
    return F.trunc(as_of_date(as_of), "quarter")


def in_quarter(day: Column, as_of: AsOf) -> Column:
    """Day lies in the calendar quarter of ``as_of``; both bounds fold to literals."""
    return (day >= quarter_start(as_of)) & (day < F.add_months(quarter_start(as_of), 3))


def month_of(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)


def close_month(day: Column, label: str) -> Column:
    """``yyyy-MM`` of a close date, or the label where there is none."""
    return F.coalesce(month_of(day), F.lit(label))
