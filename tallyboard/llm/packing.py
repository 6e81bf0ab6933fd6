"""Hierarchical multi-length packing of documents into training sequences.

A document is cut into whole windows of the longest tier and a remainder. Remainders are dealt evenly over cells; in a
cell each long one opens a window of its own tier (the shortest that holds it), the short ones fill the gaps of the
longer windows, cut where a gap ends, and what is left fills further windows of the longest tier. The level between
openers and fillers is where the fillers just cover all gaps, so that only a cell's last window is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import mix64
from tallyboard.llm.token_ids import token_ids

TIERS = (256, 512, 1024, 2048)
END_ID = 1
CELL_BYTES = 8 << 20  # text bytes in a cell, on average
STEP_WINDOWS = 8  # windows of the longest tier, in tokens, in a step group

TOKENIZED = "cell long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padded_tokens long, step_group long, ids binary"
)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize(documents: DataFrame, path: str, cells: int, window: int, keep_ids: bool = False) -> DataFrame:
    """Whole windows and remainders of every document, each with the cell it is dealt to."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seen = token_ids(path), 0
        salt = TaskContext.get().partitionId() << 32
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(encoder.encode(text), np.array(END_ID, dtype=encoder.dtype))
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    kept = part.astype("<u4").tobytes() if keep_ids or len(part) < window else None
                    if kept and encoder.dtype.itemsize == 2 and not keep_ids:
                        kept = part.tobytes()
                    rows.append((salt + seen, doc_id, start, len(part), crc32_of(part), len(ids), kept))
                    seen += 1
            out = pd.DataFrame(rows, columns=["cell", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            out["cell"] = (mix64(out["cell"].to_numpy().astype(np.uint64)) % np.uint64(cells)).astype(np.int64)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, TOKENIZED)


def opening_level(lengths: np.ndarray, tiers: tuple[int, ...]) -> int:
    """Remainders longer than this open a window; the others suffice to fill all gaps of those windows."""
    longest = tiers[-1]
    count = np.bincount(lengths, minlength=longest + 1)
    size = np.arange(longest + 1)
    gap = np.array(tiers)[np.searchsorted(tiers, size)] - size
    filled = np.cumsum(count * size)
    open_gaps = (count * gap).sum() - np.cumsum(count * gap)
    return int(np.argmax(filled >= open_gaps))


def pack_cell(frame: pd.DataFrame, tiers: tuple[int, ...] = TIERS, keep_ids: bool = False) -> pd.DataFrame:
    """Pieces of one cell, with sequence ids from 0 and step groups of about equal padded tokens."""
    longest, numbers = tiers[-1], frame["length"].to_numpy()
    order = np.lexsort((frame["ids_crc32"].to_numpy(), frame["start"].to_numpy(), frame["doc_id"].fillna(-1).to_numpy()))
    frame, length = frame.iloc[order], numbers[order]
    whole = length == longest
    level = opening_level(length[~whole], tiers)
    opens = whole | (length > level)
    openers, fillers = np.flatnonzero(opens), np.flatnonzero(~opens)
    tier = np.array(tiers)[np.searchsorted(tiers, length[openers])]

    # Fillers laid end to end on one line, gaps and further windows on another: every border is a cut.
    gaps = tier - length[openers]
    holes = np.flatnonzero(gaps)
    total = int(length[fillers].sum())
    further = max(0, -(-(total - int(gaps.sum())) // longest))
    space = np.concatenate((gaps[holes], np.full(further, longest, dtype=np.int64)))
    space_end, fill_end = np.cumsum(space), np.cumsum(length[fillers])
    cuts = np.unique(np.concatenate(([0], space_end[space_end < total], fill_end))) if total else np.zeros(1, dtype=np.int64)
    begin, size = cuts[:-1], np.diff(cuts)
    of_filler = np.searchsorted(fill_end, begin, side="right")
    of_space = np.searchsorted(space_end, begin, side="right")
    fill_start, space_start = fill_end - length[fillers], space_end - space
    n_open = len(openers)
    in_hole = of_space < len(holes)
    sequence = np.where(in_hole, np.append(holes, 0)[np.minimum(of_space, len(holes))], n_open + of_space - len(holes))
    before = np.where(in_hole, length[openers][np.minimum(sequence, max(n_open - 1, 0))] if n_open else 0, 0)

    row = np.concatenate((openers, fillers[of_filler]))
    skip = np.concatenate((np.zeros(n_open, dtype=np.int64), begin - fill_start[of_filler]))
    size = np.concatenate((length[openers], size))
    sequence = np.concatenate((np.arange(n_open), sequence))
    offset = np.concatenate((np.zeros(n_open, dtype=np.int64), before + begin - space_start[of_space]))

    out = frame.iloc[row][["doc_id", "start", "ids_crc32", "doc_tokens"]].reset_index(drop=True)
    cut = np.flatnonzero(size < length[row])
    blobs, crc = frame["ids"].to_numpy(), out["ids_crc32"].to_numpy().copy()
    width = {i: (len(blobs[i]) // int(length[i])) for i in np.unique(row[cut])}
    for i in cut:
        w = width[row[i]]
        part = blobs[row[i]][skip[i] * w : (skip[i] + size[i]) * w]
        crc[i] = crc32_of(np.frombuffer(part, dtype=f"<u{w}"))
    out["ids_crc32"], out["start"], out["length"] = crc, out["start"].to_numpy() + skip, size
    out["sequence_id"], out["offset"] = sequence, offset
    out["ids"] = [blobs[r][4 * s : 4 * (s + n)] for r, s, n in zip(row, skip, size)] if keep_ids else None

    tokens = np.bincount(sequence, size).astype(np.int64)
    padded = np.where((tokens & (tokens - 1)) == 0, tokens, longest)
    by_size = np.argsort(padded, kind="stable")
    step = np.empty(len(tokens), dtype=np.int64)
    step[by_size] = (np.cumsum(padded[by_size]) - 1) // (STEP_WINDOWS * longest)
    out["sequence_tokens"], out["padded_tokens"], out["step_group"] = tokens[sequence], padded[sequence], step[sequence]
    return out[[c.split(" ")[0] for c in PIECES.split(", ")]]


def pack(
    documents: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, cell_bytes: int = CELL_BYTES, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all `documents` (columns doc_id, text; others are not read), each id in exactly one piece.

    Null and empty texts are the end id alone; repeated rows are packed each. A sequence is padded to the longest tier
    unless its tokens are a power of two. Sequence ids are unique, `step_group` numbers groups of whole sequences whose
    padded tokens are about equal, shapes sorted. With `keep_ids` a piece carries its ids as little-endian 32-bit numbers.
    """
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    cells = max(1, round(size / cell_bytes))
    cut = tokenize(documents, path, cells, tiers[-1], keep_ids)

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = pack_cell(frame, tiers, keep_ids)
        out["sequence_id"] += int(key[0]) << 32
        out["step_group"] += int(key[0]) << 32
        return out

    return cut.groupBy("cell").applyInPandas(packed, PIECES)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(documents, default_vocabulary()).drop("ids")
