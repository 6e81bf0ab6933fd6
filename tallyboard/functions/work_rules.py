"""Predicates and derived columns of work orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard.functions.dates import AsOf, as_of_date
from tallyboard.functions.text import relabel, strip

# The five delivery categories and the spellings that fall into them.
CATEGORIES = ("Completed", "In Progress", "Pending", "Delayed", "Cancelled")
CATEGORY_SPELLINGS = {
    "Completed": ("completed", "complete", "won", "done"),
    "In Progress": ("in progress", "inprogress", "active", "executed until current month"),
    "Delayed": ("delayed", "overdue", "blocked"),
    "Cancelled": ("cancelled", "canceled", "lost", "stopped"),
}


def is_overdue(status: Column, due_date: Column, as_of: AsOf) -> Column:
    """Past its due date and not completed; a missing status is not completed."""
    return ~status.eqNullSafe("Completed") & F.coalesce(due_date < as_of_date(as_of), F.lit(False))


def is_delayed(status: Column, due_date: Column, as_of: AsOf) -> Column:
    return status.eqNullSafe("Delayed") | is_overdue(status, due_date, as_of)


def delivery_category(status: Column) -> Column:
    """One of five categories; anything unknown, and no status at all, is pending."""
    return relabel(strip(status), CATEGORY_SPELLINGS, F.lit("Pending"))


def is_delayed_interactive(status: Column, due_date: Column, as_of: AsOf) -> Column:
    """The browser's variant, on the delivery category instead of the exact status."""
    return is_delayed(delivery_category(status), due_date, as_of)
