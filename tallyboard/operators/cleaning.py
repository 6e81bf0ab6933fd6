"""From board items to clean tables and the metadata of what was missing.

Items carry ``seq``, any orderable column that gives the board order. Stages:

``flatten_items``  items -> one text column per field (and a bit mask of the titles present)
``dedupe_items``   keep the first row of each id
``clean_rows``     text columns -> typed, normalised columns
``board_meta``     counts of missing fields, dropped rows and missing columns
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions.dates import SHORT_YEARS_AROUND, AsOf, parse_date
from tallyboard.functions.numbers import parse_number
from tallyboard.functions.text import (
    SECTOR_SPELLINGS,
    STAGE_SPELLINGS,
    STATUS_SPELLINGS,
    relabel,
    strip,
    title_case,
)
from tallyboard.schemas import BoardSpec

_MARK = "\x01"
SPELLINGS = {"sector": SECTOR_SPELLINGS, "stage": STAGE_SPELLINGS, "status": STATUS_SPELLINGS}


class CleanBoard(NamedTuple):
    rows: DataFrame
    meta: DataFrame


def _bits(flags: list[Column]) -> Column:
    """Flags packed into one LONG, first flag in the lowest bit; null flags count as false."""
    packed = [F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags)]
    return reduce(lambda a, b: a.bitwiseOR(b), packed).cast("long")


def _bit(mask: Column, position: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << position)) != 0


def flatten_items(items: DataFrame, spec: BoardSpec) -> DataFrame:
    """One row per item, one stripped text column per field of the spec.

    Within an item the last cell of a title counts. Across the titles of a field the later one
    of the spec wins whenever its text is not null; empty text counts as text.
    ``titles_present`` has a bit per field that has one of its titles, in any casing.
    """
    titled = F.filter("column_values", lambda c: c["title"] != "")
    cells = items.select(
        "seq",
        strip(F.coalesce("id", F.lit(""))).alias("id"),
        strip(F.coalesce("name", F.lit(""))).alias("name"),
        F.reverse(titled).alias("cells"),
    ).select(
        "seq",
        "id",
        "name",
        F.transform("cells", lambda c: strip(c["title"])).alias("titles"),
        F.col("cells.text").alias("texts"),
    )

    def text_under(title: str) -> Column:
        return F.get("texts", F.array_position("titles", F.lit(title)).cast("int") - 1)

    def resolved(field: str) -> Column:
        return F.coalesce(*[text_under(title) for title in reversed(spec.titles_of(field))])

    # All titles in one text, each between two marks: searching it is cheaper than the array.
    listed = F.concat(F.lit(_MARK), F.lower(F.array_join("titles", _MARK)), F.lit(_MARK))
    flat = cells.select("seq", "id", "name", *[resolved(f).alias(f) for f in spec.fields], listed.alias("listed"))
    present = [
        reduce(
            lambda a, b: a | b,
            [F.contains("listed", F.lit(_MARK + t.lower() + _MARK)) for t in spec.titles_of(field)],
        )
        for field in spec.fields
    ]
    return flat.select(
        "seq",
        "id",
        "name",
        *[strip(F.col(f)).alias(f) for f in spec.fields],
        _bits(present).alias("titles_present"),
    )


# Repeated ids that are broadcast, and their bytes; a board with more or longer ones is shuffled by id.
REPEATED_IDS, ID_BYTES = 1 << 18, 256
SHARES = 16  # parts of the ids, of which one may already have too many repeated ones


def repeated_ids(flat: DataFrame) -> DataFrame:
    """``(id, copies, first, firsts)`` of ids met more than once: rows, least ``seq``, and rows that have it.

    Only ids and places are shuffled, added up before that, so that neither a hot id nor a hot place gathers.
    """
    places = flat.groupBy("id", "seq").agg(F.count(F.lit(1)).alias("n"))
    ids = places.groupBy("id").agg(
        F.sum("n").alias("copies"), F.min("seq").alias("first"), F.min_by("n", "seq").alias("firsts")
    )
    return ids.filter("copies > 1")


def _limited(flat: DataFrame) -> DataFrame:
    """First rows by a window; its limit works before the shuffle too, so a hot id sends one row per task."""
    order = Window.partitionBy("id").orderBy("seq")
    return flat.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def _few_repeated(flat: DataFrame, limit: int) -> pa.Table | None:
    """The repeated ids, if there are at most ``limit`` of at most ``ID_BYTES`` bytes.

    One of ``SHARES`` parts of the ids is looked at first: if it alone has more, there is no need to shuffle the others.
    """
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES)) == 0
    if repeated_ids(flat.filter(share)).limit(limit + 1).count() > limit:
        return None
    long = F.coalesce(F.octet_length("id") > ID_BYTES, F.lit(False))
    found = repeated_ids(flat).select(F.when(~long, F.col("id")).alias("id"), "copies", "first", "firsts", long.alias("long"))
    table = found.limit(limit + 1).toArrow()
    return None if len(table) > limit or pc.any(table["long"]).as_py() else table.drop_columns("long")


def _counted(flat: DataFrame) -> DataFrame:
    """First rows with ``copies`` by one aggregate: a task sends one row for each of its ids, and no join is needed."""
    others = [F.col(name) for name in flat.columns if name != "id"]
    firsts = flat.groupBy("id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by(F.struct(*others), F.struct("seq")).alias("_row"),  # a struct: no ``seq`` counts as the least one
    )
    return firsts.select("id", "_row.*", "copies").select(*flat.columns, "copies")


def _marked_first(flat: DataFrame, repeated: pa.Table) -> DataFrame:
    """First rows with ``copies``, null for unique ids; the repeated ids are broadcast."""
    known = flat.sparkSession.createDataFrame(repeated.rename_columns(["_id", "copies", "_first", "_firsts"]))
    seen = flat.join(F.broadcast(known), F.col("id").eqNullSafe(F.col("_id")), "left")
    first = F.col("seq").eqNullSafe(F.col("_first"))
    kept = seen.filter(F.col("copies").isNull() | (first & (F.col("_firsts") == 1)))
    if pc.max(repeated["firsts"]).as_py() > 1:
        kept = kept.unionByName(_limited(seen.filter(first & (F.col("_firsts") > 1))))
    return kept.drop("_id", "_first", "_firsts")


def _first_of_few(flat: DataFrame, limit: int) -> DataFrame | None:
    repeated = _few_repeated(flat, limit)
    if repeated is None:
        return None
    kept = _marked_first(flat, repeated) if len(repeated) else flat.withColumn("copies", F.lit(1))
    return kept.withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))


def first_rows(flat: DataFrame, limit: int = REPEATED_IDS) -> DataFrame:
    """The first row of each id by ``seq``, with ``copies``, the number of rows the id has. For whole rows of a board.

    A pass over ids and places alone, run at once, tells which ids repeat. Up to ``limit`` of them are broadcast and the rows
    pass them where they are: a row of a unique id is neither shuffled nor sorted. With more, the rows are shuffled by id, once.
    Where several rows of an id share the first place, any one of them is kept.
    """
    few = _first_of_few(flat, limit)
    return _counted(flat) if few is None else few


def dedupe_items(flat: DataFrame, limit: int = REPEATED_IDS) -> DataFrame:
    """Keep the first row of each id by ``seq``; only ids that repeat are looked up, see ``first_rows``.

    With more than ``limit`` of them the rows go through a window alone: nothing is counted.
    """
    few = _first_of_few(flat, limit)
    return _limited(flat) if few is None else few.drop("copies")


def _cased(flat: DataFrame, spec: BoardSpec, *others: str | Column) -> DataFrame:
    """Text fields blanked to null and title-cased, in a projection of its own: once per row."""

    def cased(field: str) -> Column:
        if field not in spec.text:
            return F.col(field)
        filled = F.nullif(F.col(field), F.lit(""))
        return (title_case(filled) if field in SPELLINGS else filled).alias(field)

    return flat.select("id", "name", *[cased(f) for f in spec.fields], *others)


def _cleaned(field: str, spec: BoardSpec, as_of: AsOf) -> Column:
    if field in spec.numeric:
        return parse_number(F.col(field)).alias(field)
    if field in spec.dates:
        return parse_date(F.col(field), as_of).alias(field)
    if field in SPELLINGS:
        return relabel(F.col(field), SPELLINGS[field], F.col(field)).alias(field)
    return F.col(field)


def clean_rows(flat: DataFrame, spec: BoardSpec, as_of: AsOf = SHORT_YEARS_AROUND) -> DataFrame:
    """Typed and normalised columns; every rule is a column expression, so unused ones are pruned."""
    return _cased(flat, spec).select("id", "name", *[_cleaned(f, spec, as_of) for f in spec.fields])


def clean_flat(flat: DataFrame, spec: BoardSpec, as_of: AsOf = SHORT_YEARS_AROUND) -> DataFrame:
    """Clean rows for one question, wholly lazy: only the columns it uses are shuffled by id."""
    return clean_rows(_limited(flat), spec, as_of)


def _is_missing(spec: BoardSpec, field: str, as_of: AsOf) -> Column:
    """What counts as missing: null numbers (not blank ones), blank text, unparseable dates only."""
    text = F.col(field)
    if field in spec.numeric:
        return text.isNull()
    if field in spec.dates:
        return (text != "") & parse_date(text, as_of).isNull()
    return text.isNull() | (text == "")


def board_meta(flat: DataFrame, spec: BoardSpec, as_of: AsOf = SHORT_YEARS_AROUND) -> DataFrame:
    """META rows of a board from its flattened items, in one pass.

    Each row shrinks to ``(id, seq, two bit masks)`` before the shuffle. The first row of each
    id gives the missing flags, the first row of the board the titles that exist.
    """
    slim = flat.select(
        "id",
        "seq",
        "titles_present",
        _bits([_is_missing(spec, field, as_of) for field in spec.fields]).alias("missing"),
    )
    firsts = slim.groupBy("id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("seq").alias("seq"),
        F.min_by("missing", "seq").alias("missing"),
        F.min_by("titles_present", "seq").alias("titles_present"),
    )
    return meta_of_marks(firsts, spec)


def clean_marked(flat: DataFrame, spec: BoardSpec, as_of: AsOf = SHORT_YEARS_AROUND) -> DataFrame:
    """Clean rows that also carry the marks META is counted from, all in one pass over the board.

    For boards that are stored: ``copies``, ``seq``, ``missing`` and ``titles_present`` stand
    beside the clean columns.
    """
    firsts = first_rows(flat.select("id", "seq", "name", *spec.fields, "titles_present"))
    marks = ["copies", "seq", "titles_present"]
    parsed = {f"text_of_{field}": F.col(field) for field in spec.numeric + spec.dates}
    typed = _cased(firsts.withColumns(parsed), spec, *marks, *parsed).select("id", "name", *[_cleaned(f, spec, as_of) for f in spec.fields], *marks, *parsed)

    def missing(field: str) -> Column:
        if field in spec.dates:
            return (F.col(f"text_of_{field}") != "") & F.col(field).isNull()
        return F.col(f"text_of_{field}" if field in spec.numeric else field).isNull()

    flags = _bits([missing(field) for field in spec.fields]).alias("missing")
    return typed.select("id", "name", *spec.fields, *marks, flags)


def meta_of_marks(firsts: DataFrame, spec: BoardSpec) -> DataFrame:
    """META rows from one row per id with its copies, place, missing flags and titles."""
    missing_counts = [F.count_if(_bit(F.col("missing"), i)).alias(f"missing_{i}") for i in range(len(spec.fields))]
    totals = firsts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("kept_rows"),
        F.coalesce(F.min_by("titles_present", "seq"), F.lit(0)).alias("titles_present"),
        *missing_counts,
    )

    def row(metric: str, field: str | None, count: Column) -> Column:
        return F.struct(
            F.lit(spec.board).alias("board"),
            F.lit(metric).alias("metric"),
            F.lit(field).cast("string").alias("field"),
            count.cast("bigint").alias("count"),
        )

    rows = [
        row("total_rows", None, F.col("total_rows")),
        row("dropped_rows", None, F.col("total_rows") - F.col("kept_rows")),
    ]
    for i, field in enumerate(spec.fields):
        rows.append(row("missing_field", field, F.col(f"missing_{i}")))
        rows.append(row("missing_column", field, (~_bit(F.col("titles_present"), i)).cast("int")))
    return totals.select(F.inline(F.array(*rows))).filter("count > 0 OR metric IN ('total_rows', 'dropped_rows')")


def count_missing(flat: DataFrame, spec: BoardSpec) -> DataFrame:
    """``(board, field, count)`` of the missing fields."""
    return board_meta(flat, spec).filter("metric = 'missing_field'").select("board", "field", "count")


def missing_columns(flat: DataFrame, spec: BoardSpec) -> DataFrame:
    """``(board, field)`` of fields without any title on the first item of the board."""
    return board_meta(flat, spec).filter("metric = 'missing_column'").select("board", "field")


def missing_columns_union(*metas: DataFrame) -> DataFrame:
    """Distinct fields missing on any of the boards."""
    return (
        reduce(DataFrame.unionByName, metas).filter("metric = 'missing_column'").select("field").distinct()
    )


def clean_board(items: DataFrame, spec: BoardSpec, as_of: AsOf = SHORT_YEARS_AROUND) -> CleanBoard:
    """The whole pipeline: whole rows, and META counted from the same marked rows.

    Both are read from the board in one pass each; to have them in one together, store them with ``staged_board``.
    """
    marked = clean_marked(flatten_items(items, spec), spec, as_of)
    return CleanBoard(marked.select("id", "name", *spec.fields), meta_of_marks(marked, spec))
