"""Number parsing and exact money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as the number in a text.
_FIRST_NUMBER = r"[-+]?\d*\.\d+|\d+"


def parse_number(text: Column) -> Column:
    """First number in the text after dropping ``,`` and ``%``; 0.0 where there is none."""
    bare = F.translate(text, ",%", "")
    number = F.nullif(F.regexp_extract(bare, _FIRST_NUMBER, 0), F.lit(""))
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


# Amounts below this are added as decimals; their sum stays exact for 10 ** 14 rows.
EXACT_BELOW = 1e18


def _sums(amount: Column) -> tuple[Column, Column]:
    """Exact sum of the amounts of ordinary size, and the double sum of the rest; null where there are none."""
    fits = F.abs(amount) < EXACT_BELOW
    exact = F.sum(F.when(fits, amount).cast("decimal(28,6)"))
    return exact, F.sum(F.when(~fits, amount.cast("double")))


def money_sum(amount: Column) -> Column:
    """Unrounded sum, for results that are added up further; 0 for no rows."""
    exact, rest = _sums(amount)
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def money_total(amount: Column) -> Column:
    """Sum that does not depend on row order: added as decimals, rounded to cents, 0 for no rows.

    An amount too large for that, such as a reference number in the wrong column, is added as a double at the end: it
    neither stops the query nor gets lost.
    """
    exact, rest = _sums(amount)
    return F.coalesce(F.round(exact, 2).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def money_parts(amount: Column) -> dict[str, Column]:
    """Sums of a part of the rows, for ``money_of_parts`` to add up without loss."""
    exact, rest = _sums(amount)
    return {"exact": exact, "rest": rest}


def money_of_parts(rounded: bool = False, which: Column | None = None) -> Column:
    """``money_sum``, or ``money_total``, of rows whose parts are in the columns ``exact`` and ``rest``; ``which`` of them."""
    exact, rest = (F.col(part) if which is None else F.when(which, F.col(part)) for part in ("exact", "rest"))
    exact = F.sum(exact)
    exact = (F.round(exact, 2) if rounded else exact).cast("double")
    return F.coalesce(exact, F.lit(0.0)) + F.coalesce(F.sum(rest), F.lit(0.0))


def money_of_list(amounts: Column) -> Column:
    """``money_total`` of the amounts in a short array."""
    fits = F.filter(amounts, lambda a: F.abs(a) < EXACT_BELOW)
    nothing = F.lit(0).cast("decimal(38,6)")
    exact = F.aggregate(fits, nothing, lambda total, a: (total + a.cast("decimal(28,6)")).cast("decimal(38,6)"))
    rest = F.aggregate(F.filter(amounts, lambda a: F.abs(a) >= EXACT_BELOW), F.lit(0.0), lambda total, a: total + a)
    return F.round(exact, 2).cast("double") + rest
