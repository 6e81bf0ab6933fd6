"""Text rules as Spark columns: stripping, title case and the category cleaners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes; all of them lie below U+3001.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Cased letters, the characters str.title() looks at.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_RUNS = f"([{_CASED}]+|[^{_CASED}]+)"

# Lower-case spellings of a category and the label they are shown under.
SECTOR_SPELLINGS = {
    "Agriculture": ("agri", "agro"),
    "Infrastructure": ("infra", "construction"),
    "Energy": ("power", "renewables"),
}
STAGE_SPELLINGS = {
    "Won": ("won", "won deal", "closed won"),
    "Lost": ("lost", "lost deal", "closed lost"),
}
STATUS_SPELLINGS = {
    "In Progress": ("in progress", "inprogress", "active"),
    "Not Started": ("not started", "notstarted", "backlog"),
    "Delayed": ("delayed", "overdue", "blocked"),
}


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` alone removes spaces only).

    Text that starts and ends with visible ASCII, nearly all of it, is passed through.
    """

    def needs_look(char: Column) -> Column:
        return (char < "!") | (char > "~")

    return F.when(
        needs_look(text) | needs_look(F.substring(text, -1, 1)), F.btrim(text, F.lit(WHITESPACE))
    ).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Strip, then turn blank text into null."""
    return F.nullif(strip(text), F.lit(""))


def title_case(text: Column) -> Column:
    """Capitalise each run of letters (``3rd`` becomes ``3Rd``, ``o'neil`` ``O'Neil``)."""
    by_run = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_RUNS), F.lit(1)), F.initcap), "")
    # Plain words need no run splitting; initcap stays inside generated code.
    return F.when(text.rlike("^[A-Za-z ]*$"), F.initcap(text)).otherwise(by_run)


def literal_map(entries: dict[str, str | float]) -> Column:
    """A constant map, folded into the plan as one literal."""

    def literal(value: str | float) -> str:
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else f"{value}D"

    return F.expr("map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in entries.items()) + ")")


def relabel(text: Column, spellings: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    """The label whose spellings include ``text`` in any casing, else ``otherwise``."""
    labels = literal_map({variant: label for label, variants in spellings.items() for variant in variants})
    return F.coalesce(F.try_element_at(labels, F.lower(text)), otherwise)


def clean_sector(text: Column) -> Column:
    titled = title_case(normalize_text(text))
    return relabel(titled, SECTOR_SPELLINGS, titled)


def clean_stage(text: Column) -> Column:
    titled = title_case(normalize_text(text))
    return relabel(titled, STAGE_SPELLINGS, titled)


def clean_status(text: Column) -> Column:
    titled = title_case(normalize_text(text))
    return relabel(titled, STATUS_SPELLINGS, titled)


def labelled(text: Column, label: str = "Unassigned") -> Column:
    """Null shown under a label."""
    return F.coalesce(text, F.lit(label))
