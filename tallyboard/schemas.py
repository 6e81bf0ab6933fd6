"""Schemas of pages, items, clean tables and metadata, and the two board specifications."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in fields.items()])


_TEXT = StringType()

RAW_CELL = _struct(id=_TEXT, column=_struct(title=_TEXT), title=_TEXT, text=_TEXT, value=_TEXT)
RAW_ITEM = _struct(id=_TEXT, name=_TEXT, column_values=ArrayType(RAW_CELL))


def page_of(item: StructType) -> StructType:
    """One landed document, the first page of a board or a later one, with its ordinal and items of the given fields."""
    listed = _struct(cursor=_TEXT, items=ArrayType(item))
    return _struct(page=LongType(), data=_struct(boards=ArrayType(_struct(items_page=listed)), next_items_page=listed))


DEALS = _struct(
    id=_TEXT,
    name=_TEXT,
    sector=_TEXT,
    stage=_TEXT,
    value=DoubleType(),
    probability=DoubleType(),
    expected_close_date=DateType(),
    owner=_TEXT,
)
WORK_ORDERS = _struct(
    id=_TEXT,
    name=_TEXT,
    status=_TEXT,
    start_date=DateType(),
    due_date=DateType(),
    sector=_TEXT,
    assigned_to=_TEXT,
)
META = _struct(board=_TEXT, metric=_TEXT, field=_TEXT, count=LongType())


@dataclass(frozen=True)
class BoardSpec:
    """What a board's columns mean.

    ``aliases`` lists ``(column title, field)``; where several titles of one field carry text,
    the later entry wins.
    """

    board: str
    aliases: tuple[tuple[str, str], ...]
    numeric: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    fields: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(dict.fromkeys(name for _, name in self.aliases)))

    def titles_of(self, field_name: str) -> list[str]:
        return [title for title, name in self.aliases if name == field_name]


# Column titles of the deals board.
DEALS_BOARD = BoardSpec(
    board="Deals",
    aliases=(
        ("Sector", "sector"),
        ("Sector/service", "sector"),
        ("Sector/Service", "sector"),
        ("service", "sector"),
        ("Stage", "stage"),
        ("Deal Stage", "stage"),
        ("Value", "value"),
        ("Deal Value", "value"),
        ("Masked Deal value", "value"),
        ("Masked Deal Value", "value"),
        ("Probability", "probability"),
        ("Expected Close Date", "expected_close_date"),
        ("Owner", "owner"),
        ("Owner code", "owner"),
        ("Owner Code", "owner"),
    ),
    numeric=("value", "probability"),
    dates=("expected_close_date",),
    text=("sector", "stage", "owner"),
)

# Column titles of the work-orders board.
WORK_ORDERS_BOARD = BoardSpec(
    board="Work Orders",
    aliases=(
        ("Status", "status"),
        ("Work Order Date", "start_date"),
        ("Due Date", "due_date"),
        ("Sector", "sector"),
        ("Sector/service", "sector"),
        ("Sector/Service", "sector"),
        ("Assignee", "assigned_to"),
        ("Assigned To", "assigned_to"),
    ),
    dates=("start_date", "due_date"),
    text=("status", "sector", "assigned_to"),
)

# The same board where the start column carries its older title.
WORK_ORDERS_BOARD_START_DATE = BoardSpec(
    board="Work Orders",
    aliases=(
        ("Status", "status"),
        ("Start Date", "start_date"),
        ("Due Date", "due_date"),
        ("Sector", "sector"),
        ("Assigned To", "assigned_to"),
    ),
    dates=("start_date", "due_date"),
    text=("status", "sector", "assigned_to"),
)
