"""Removal of repeated byte strings by suffix arrays.

A string of `LENGTH` bytes is named by its anchor: the least of its hashed grams, leftmost on ties. Equal strings have equal
anchors at equal places, so a string can repeat only where its anchor does. A context is the run of consecutive strings with
one anchor in a document. First, contexts meet by anchor: repeats of a whole context are settled there, and an anchor with
one context is done. The first copies of the contexts of all other anchors go to shards; a shard sorts their suffixes
(Larsson-Sadakane refinement), finds common prefixes (Kasai) and thereby all strings that repeat in it. Anchors with very
many contexts are spread over shards, whose sorted strings are then merged range by range by binary search.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import mix64, stored

LENGTH = 100
GRAM = 24
FLUSH = 1 << 20  # contexts packed at a time
BUCKET_BYTES = 4 << 20  # of text per bucket of contexts
SHARD_BYTES = 2 << 20  # of context text per suffix array
SPREAD = 4096  # contexts of one anchor in one shard
CONTEXT = np.dtype([("anchor", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("start", "<u4"), ("count", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("row", "<u4"), ("start", "<u4"), ("count", "<u4")])
WANTED = np.dtype([("doc", "<i8"), ("row", "<u4"), ("start", "<u4"), ("count", "u1"), ("anchor", "<u8"), ("salt", "<u2"), ("salts", "<u2")])
PIECE = np.dtype([("doc", "<i8"), ("row", "<u4"), ("start", "<u4"), ("count", "u1"), ("salts", "<u2")])
STRING = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("start", "<u4")])
STEP = 0xD1B54A32D192ED03


# --- anchors and contexts ---


@cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.array([1] + [STEP] * (length - 1), dtype=np.uint64)
    back = np.array([1] + [pow(STEP, -1, 1 << 64)] * (length - 1), dtype=np.uint64)
    return np.cumprod(step), np.cumprod(back)


@cache
def _byte_values() -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(99))


def _words(data: bytes, count: int, at: int) -> np.ndarray:
    """The eight bytes from each of `count` positions on, as numbers."""
    return np.ndarray((count,), dtype="<u8", buffer=data, offset=at, strides=(1,)).copy()


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def row_name(data: bytes) -> int:
    """Tells rows that share a doc_id apart by a checksum of their text, the one that Spark joins them on."""
    return zlib.crc32(data)


def contexts_of(doc_id: int, data: bytes) -> np.ndarray:
    """The contexts of one document, in order."""
    strings = len(data) - LENGTH + 1
    if strings <= 0:
        return np.empty(0, dtype=CONTEXT)
    grams = len(data) - GRAM + 1
    a, b, c = (_words(data, grams, at) for at in (0, 8, GRAM - 8))
    a *= np.uint64(0x9E3779B97F4A7C15)
    a ^= b
    a *= np.uint64(0xC2B2AE3D27D4EB4F)
    a ^= a >> np.uint64(29)
    a ^= c
    gram = mix64(a)
    place = _window_least((gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64), LENGTH - GRAM + 1)
    place &= np.uint64(0xFFFFFFFF)
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    count = np.diff(np.append(start, strings))
    at = place[start].astype(np.int64)
    power, back = _powers(1 << max(14, int(len(data) - 1).bit_length()))
    values = _byte_values()[np.frombuffer(data, dtype=np.uint8)] * power[: len(data)]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values)))
    held = (sums[start + count + LENGTH - 1] - sums[start]) * back[start]
    out = np.empty(len(start), dtype=CONTEXT)
    out["anchor"], out["doc"], out["row"], out["start"], out["count"] = gram[at], doc_id, row_name(data), start, count
    out["print"] = mix64(held ^ mix64((count * 256 + at - start).astype(np.uint64)))
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort((rows["start"], rows["row"], rows["doc"], rows["print"], rows["anchor"]))


def _first_copies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts sorted by anchor and print, each place once, and which of them come first among equal ones."""
    rows = rows[_order(rows)]
    again = np.ones(max(len(rows) - 1, 0), dtype=bool)  # rows of equal doc_id and text hold the same places
    for name in ("anchor", "print", "doc", "row", "start"):
        again &= rows[name][1:] == rows[name][:-1]
    rows = rows[np.append(True, ~again)] if len(rows) else rows
    new = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["print"][1:] != rows["print"][:-1])
    return rows, np.append(True, new) if len(rows) else new


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Runs of repeated strings, those that touch made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["row"], spans["doc"]))]
    end = spans["start"].astype(np.int64) + spans["count"]
    same = (spans["doc"][1:] == spans["doc"][:-1]) & (spans["row"][1:] == spans["row"][:-1])
    document = np.concatenate(([0], np.cumsum(~same)))
    top = np.maximum.accumulate(end + document * (1 << 33)) - document * (1 << 33)
    fresh = np.append(True, ~same | (spans["start"][1:] > top[:-1]))
    begin = np.flatnonzero(fresh)
    out = spans[begin].copy()
    out["count"] = top[np.append(begin[1:], len(spans)) - 1] - out["start"]
    return out


def _as_spans(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=SPAN)
    for name in SPAN.names:
        out[name] = rows[name]
    return out


def _blobs(key: np.ndarray, rows: np.ndarray, kind: str) -> Iterator[dict]:
    """One packed row per key."""
    order = np.argsort(key, kind="stable")
    used, begin = np.unique(key[order], return_index=True)
    for k, part in zip(used.tolist(), np.split(order, begin[1:])):
        yield {"bucket": int(k), "kind": kind, "blob": rows[part].tobytes()}


BLOBS = "bucket long, kind string, blob binary"


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "blob"])


def _utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def packed_contexts(documents: DataFrame, buckets: int) -> DataFrame:
    """Contexts of all documents packed by anchor; copies within a flush leave it as spans only."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            rows, first = _first_copies(np.concatenate(held))
            spans = joined_spans(_as_spans(rows[~first]))
            kept = rows[first]
            out = list(_blobs((kept["anchor"] % np.uint64(buckets)).astype(np.int64), kept, "context"))
            out += _blobs((mix64(spans["doc"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), spans, "span")
            return _frame(out)

        total = 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                rows = contexts_of(int(doc_id), _utf8(text))
                held.append(rows)
                total += len(rows)
                if total >= FLUSH:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    return documents.mapInPandas(emit, BLOBS)


def settle_contexts(frame: pd.DataFrame, buckets: int, spread: int = SPREAD) -> pd.DataFrame:
    """One bucket of anchors: spans of repeated contexts, and the first copies that suffix arrays must compare."""
    out: list[dict] = []
    spans = [np.frombuffer(b, dtype=SPAN) for b in frame["blob"][frame["kind"] == "span"]]
    packed = [np.frombuffer(b, dtype=CONTEXT) for b in frame["blob"][frame["kind"] == "context"]]
    if packed:
        rows, first = _first_copies(np.concatenate(packed))
        spans.append(_as_spans(rows[~first]))
        rows = rows[first]
        begin = np.flatnonzero(np.append(True, rows["anchor"][1:] != rows["anchor"][:-1]))
        size = np.diff(np.append(begin, len(rows)))
        several = np.repeat(size > 1, size)
        rows, size = rows[several], np.repeat(size, size)[several]
        wanted = np.empty(len(rows), dtype=WANTED)
        for name in ("doc", "row", "start", "count", "anchor"):
            wanted[name] = rows[name]
        wanted["salts"] = np.minimum(-(-size // spread), 65535)
        wanted["salt"] = rows["print"] % np.maximum(wanted["salts"], 1)
        out += _blobs((mix64(wanted["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), wanted, "wanted")
    joined = joined_spans(np.concatenate(spans)) if spans else np.empty(0, dtype=SPAN)
    out += _blobs((mix64(joined["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), joined, "span")
    return _frame(out)


def by_document(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket of documents: each row's spans and wanted contexts."""
    found: dict[tuple[int, int], dict[str, bytes]] = {}
    for kind, dtype in (("span", SPAN), ("wanted", WANTED)):
        packed = [np.frombuffer(b, dtype=dtype) for b in frame["blob"][frame["kind"] == kind]]
        if not packed:
            continue
        rows = np.concatenate(packed)
        rows = joined_spans(rows) if kind == "span" else rows[np.lexsort((rows["start"], rows["row"], rows["doc"]))]
        begin = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["row"][1:] != rows["row"][:-1])))
        for part in np.split(rows, begin[1:]) if len(rows) else []:
            found.setdefault((int(part["doc"][0]), int(part["row"][0])), {})[kind] = part.tobytes()
    rows = [(doc, row, x.get("span"), x.get("wanted")) for (doc, row), x in found.items()]
    return pd.DataFrame(rows, columns=["doc_id", "row_name", "span", "wanted"])


# --- suffix arrays ---


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of `data` in the order of the suffixes that begin there; the end counts as less than any byte.

    Larsson-Sadakane: a pass doubles the sorted depth by the ranks that lie as far ahead, and touches only positions whose
    group still holds several. The sort is complete, which the common prefixes rely on.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8))).tobytes()
    keys = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    begin = np.append(True, keys[order][1:] != keys[order][:-1]) if n else np.empty(0, dtype=bool)
    group = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = group, -1
    sorted_to = 8
    while True:
        open_places = np.flatnonzero(~(begin & np.append(begin[1:], True)))
        if not len(open_places):
            break
        own = order[open_places]
        ahead = np.where(own + sorted_to < n, rank[np.minimum(own + sorted_to, n)], -1 - own)  # a shorter suffix is less
        sort = np.lexsort((ahead, group[open_places]))
        own, ahead, old = own[sort], ahead[sort], group[open_places]
        order[open_places] = own
        fresh = np.append(True, (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1]))
        begin[open_places] = fresh
        group[open_places] = np.maximum.accumulate(np.where(fresh, open_places, 0))
        rank[own] = group[open_places]
        sorted_to *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in `order`, up to `cap`.

    Kasai: along a text the value falls by one at most per position. All texts (`begin`, `size`) advance together.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(cap + 1, dtype=np.uint8)))
    before = np.empty(n, dtype=np.int64)
    before[order[1:]], before[order[:1]] = order[:-1], -1
    prefix = np.zeros(n, dtype=np.int64)
    lanes = np.argsort(-size, kind="stable")
    begin, size = begin[lanes], size[lanes]
    held = np.zeros(len(begin), dtype=np.int64)
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -step, side="left"))
        at = begin[:live] + step
        other = before[at]
        held[:live] = np.where(other < 0, 0, np.maximum(held[:live] - 1, 0))
        grow = np.flatnonzero((other >= 0) & (held[:live] < cap))
        while len(grow):
            same = padded[at[grow] + held[grow]] == padded[other[grow] + held[grow]]
            grow = grow[same]
            held[grow] += 1
            grow = grow[held[grow] < cap]
        prefix[at] = held[:live]
    return prefix


def repeated_strings(pieces: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, firsts): per string of the contexts, its place (piece, offset), split by whether an equal one is earlier."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    order = suffix_array(data)
    prefix = common_prefixes(data, order, begin, size, LENGTH)
    count = pieces["count"].astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(len(piece)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    rank = np.empty(len(data), dtype=np.int64)
    rank[order] = np.arange(len(data))
    place = rank[begin[piece] + offset]
    sort = np.argsort(place)
    piece, offset, place = piece[sort], offset[sort], place[sort]
    shared = np.minimum.reduceat(prefix[order], place + 1, axis=0)[:-1] if len(place) > 1 and place[-1] + 1 < len(data) else None
    if shared is None:
        shared = np.array([prefix[order[a + 1 : b + 1]].min() for a, b in zip(place[:-1], place[1:])], dtype=np.int64)
    group = np.concatenate(([0], np.cumsum(shared < LENGTH)))
    start = pieces["start"][piece].astype(np.int64) + offset
    earliest = np.lexsort((start, pieces["row"][piece], pieces["doc"][piece], group))
    first = np.append(True, group[earliest][1:] != group[earliest][:-1])
    found = np.stack((piece[earliest], offset[earliest]), axis=1)
    return found[~first], found[first]


def _string_spans(pieces: np.ndarray, found: np.ndarray) -> np.ndarray:
    spans = np.empty(len(found), dtype=SPAN)
    spans["doc"], spans["row"] = pieces["doc"][found[:, 0]], pieces["row"][found[:, 0]]
    spans["start"], spans["count"] = pieces["start"][found[:, 0]] + found[:, 1], 1
    return joined_spans(spans)


def search_shard(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One shard: spans of its repeated strings, and the sorted strings of spread anchors cut into ranges."""
    pieces = np.concatenate([np.frombuffer(b, dtype=PIECE) for b in frame["blob"]])
    texts, at = [], 0
    body = b"".join(frame["text"])
    for count in pieces["count"].tolist():
        texts.append(body[at : at + count + LENGTH - 1])
        at += count + LENGTH - 1
    places = np.unique(pieces[["doc", "row", "start"]], return_index=True)[1]  # rows of equal doc_id and text send the same ones
    pieces, texts = pieces[places], [texts[i] for i in places.tolist()]
    repeats, firsts = repeated_strings(pieces, texts)
    spans = _string_spans(pieces, repeats)
    out = list(_blobs((mix64(spans["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), spans, "span"))
    spread = firsts[pieces["salts"][firsts[:, 0]] > 1]
    if len(spread):
        rows = np.empty(len(spread), dtype=STRING)
        names = [hashlib.blake2b(texts[p][o : o + LENGTH], digest_size=16).digest() for p, o in spread.tolist()]
        rows["high"], rows["low"] = np.frombuffer(b"".join(names), dtype=">u8").reshape(-1, 2).T
        rows["doc"], rows["row"] = pieces["doc"][spread[:, 0]], pieces["row"][spread[:, 0]]
        rows["start"] = pieces["start"][spread[:, 0]] + spread[:, 1]
        rows = rows[np.lexsort((rows["low"], rows["high"]))]
        borders = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
        cuts = np.concatenate(([0], np.searchsorted(rows["high"], borders), [len(rows)]))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            out.append({"bucket": k, "kind": "string", "blob": rows[cuts[k] : cuts[k + 1]].tobytes()})
    return _frame(out)


def merge_strings(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One range of sorted strings from several shards: each list finds its places in the merged one by binary search."""
    lists = [np.frombuffer(b, dtype=STRING) for b in frame["blob"]]
    names = np.unique(np.concatenate([x[["high", "low"]] for x in lists]))
    high = names["high"]
    rows = np.concatenate(lists)
    place = np.concatenate([np.searchsorted(high, x["high"]) for x in lists])
    while len(wrong := np.flatnonzero(names["low"][place] != rows["low"])):  # names that share their first half
        place[wrong] += 1
    earliest = np.lexsort((rows["start"], rows["row"], rows["doc"], place))
    first = np.append(True, place[earliest][1:] != place[earliest][:-1])
    again = rows[earliest][~first]
    spans = np.empty(len(again), dtype=SPAN)
    for name in ("doc", "row", "start"):
        spans[name] = again[name]
    spans["count"] = 1
    spans = joined_spans(spans)
    return _frame(list(_blobs((mix64(spans["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), spans, "span")))


def _context_texts(documents: DataFrame, shards: int) -> DataFrame:
    """Wanted contexts of joined documents (wanted, text) packed by shard, with their bytes."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts: dict[int, tuple[list, list]] = {}
            for wanted, text in zip(frame["wanted"], frame["text"]):
                data = _utf8(text)
                rows = np.frombuffer(wanted, dtype=WANTED)
                key = mix64(rows["anchor"] + rows["salt"]) % np.uint64(shards)
                pieces = np.empty(len(rows), dtype=PIECE)
                for field in PIECE.names:
                    pieces[field] = rows[field]
                for k, piece, start, count in zip(key.tolist(), pieces, rows["start"].tolist(), rows["count"].tolist()):
                    own = parts.setdefault(k, ([], []))
                    own[0].append(piece.tobytes())
                    own[1].append(data[start : start + count + LENGTH - 1])
            yield pd.DataFrame(
                {"shard": list(parts), "blob": [b"".join(x[0]) for x in parts.values()], "text": [b"".join(x[1]) for x in parts.values()]}
            )

    return documents.select("wanted", "text").mapInPandas(emit, "shard long, blob binary, text binary")


# --- results ---


def cut_spans(data: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    """What is left of `data` without the bytes of all strings in `spans`, and the number of removed runs."""
    kept, at, runs = [], 0, 0
    for start, count in zip(spans["start"].tolist(), spans["count"].tolist()):
        end = start + count + LENGTH - 1
        if start > at or not runs:
            runs += 1
        kept.append(data[at:start])
        at = max(at, end)
    kept.append(data[at:])
    return b"".join(kept), runs


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(
    documents: DataFrame, keep_bytes: bool = True, spread: int = SPREAD, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Every row of `documents` (doc_id, text; others are not read) without bytes that a string of 100 bytes repeats.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same one.
    All strings are judged on the input. Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining
    bytes, if `keep_bytes`). Null texts are empty; rows of equal doc_id and text are one document and get equal results; rows
    with a null doc_id come before all others.
    """
    least = -(1 << 63)
    documents = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), "text")
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    packed = packed_contexts(documents, buckets)
    settled = packed.groupBy("bucket").applyInPandas(lambda f: settle_contexts(f, buckets, spread), BLOBS)
    schema = "doc_id long, row_name long, span binary, wanted binary"
    known = stored(settled.groupBy("bucket").applyInPandas(by_document, schema), "known-spans")
    wanted = known.filter("wanted is not null").select("doc_id", "row_name", "wanted")
    volume = wanted.agg(F.sum(F.octet_length("wanted")).alias("n")).first()["n"] or 0
    shards = max(1, -(-(volume // WANTED.itemsize * (LENGTH + 30)) // shard_bytes))

    row = ["doc_id", "row_name"]  # rows of one doc_id, null ones above all, do not meet each other
    rows = documents.withColumn("row_name", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")))
    texts = _context_texts(rows.join(wanted, row), shards)
    searched = texts.groupBy("shard").applyInPandas(lambda f: search_shard(f, buckets), BLOBS)
    searched = stored(searched, "shard-spans")
    merged = searched.filter("kind = 'string'").groupBy("bucket").applyInPandas(lambda f: merge_strings(f, buckets), BLOBS)
    more = searched.filter("kind = 'span'").unionByName(merged).groupBy("bucket").applyInPandas(by_document, schema)
    spans = known.filter("span is not null").select(*row, "span").unionByName(more.select(*row, "span"))
    spans = spans.groupBy(*row).agg(F.collect_list("span").alias("spans"))  # of one text

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, spans in zip(frame["doc_id"], frame["text"], frame["spans"]):
                data = _utf8(text)
                own = [np.frombuffer(span, dtype=SPAN) for span in (spans if spans is not None else [])]
                kept, runs = cut_spans(data, joined_spans(np.concatenate(own))) if own else (data, 0)
                shown = None if doc_id == least else doc_id
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((shown, len(data), len(data) - len(kept), runs, digest, kept if keep_bytes else None))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESULT.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return rows.join(spans, row, "left").mapInPandas(finish, RESULT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes removed from all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(documents, keep_bytes=False).drop("kept")
