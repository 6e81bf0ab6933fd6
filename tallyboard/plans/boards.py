"""Boards stored for reports that read them more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyboard.operators.cleaning import CleanBoard, clean_marked, meta_of_marks
from tallyboard.schemas import BoardSpec
from tallyboard.sources.sinks import stage_table


def staged_board(flat: DataFrame, spec: BoardSpec) -> CleanBoard:
    """Clean rows and META of a flattened board, read from its source once.

    Both are Parquet in the shared folder: the branches of a report scan only their columns.
    """
    name = spec.board.lower().replace(" ", "-")
    marked = stage_table(clean_marked(flat, spec), name)
    meta = stage_table(meta_of_marks(marked, spec), f"{name}-meta")
    return CleanBoard(marked.select("id", "name", *spec.fields), meta)
