"""Alignment of two tokenizers' tokens by interval coalescing, and how often their ids meet in the corpus.

Both tokenizers cut the same bytes. Sorted by start, with the running maximum of their ends, the tokens of a text fall into
groups: a group ends where the next start reaches the maximum, so where tokens of both sides end. Within a group every token of
one side is linked with every one of the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import batches_by_size, stored
from tallyboard.llm.token_ids import printed_bytes, token_ids

BATCH_BYTES = 1 << 20  # text aligned at once; a longer text stands alone
LINKS_AT_ONCE = 1 << 21
GROUPS_AT_ONCE = 1 << 19  # written out at once for the digests
MAX_PAIRS = 1 << 22  # id pairs whose counts are broadcast at once, 17 bytes each
CACHED_WORDS = 400_000
SIDE_BITS = 24  # of an id pair's code, for the second id
WORD = re.compile(" +[^ ]*|[^ ]+")
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class PieceIds:
    """Ids of a text that begins with a space, by a piece vocabulary that adds it.

    No piece holds a space after another character, so merges never reach over the start of a run of spaces: such words are
    encoded apart and remembered. A vocabulary with such a piece gets its texts whole.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        space = self.model.piece_to_id("▁")
        self.by_word = space != self.model.unk_id() and not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
            else b"" if self.model.is_control(i) or self.model.is_unknown(i)
            else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes = np.array(list(map(len, self.bytes)), dtype=np.int64)
        self.first = {" ": np.array([space], dtype=np.int32).tobytes()}  # a last space: the model gives an empty text no piece
        self.known, self.altered = dict(self.first), set()  # words whose ids do not spell them are known too

    def _learn(self, words: list[str]) -> None:
        """Encode several words in one call, and compare their bytes at once where every word has the length of its ids."""
        listed = self.model.encode([word[1:] for word in words], num_threads=1)
        ids = np.array(list(chain.from_iterable(listed)), dtype=np.int32)
        raw = [word.encode() for word in words]
        stops = np.cumsum([0, *map(len, listed)])
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[stops[1:]]
        spelt = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if np.array_equal(ends, np.cumsum(list(map(len, raw)))) and spelt == b"".join(raw):
            packed, bounds = ids.tobytes(), (stops * ids.itemsize).tolist()
            self.known.update((word, packed[lo:hi]) for word, lo, hi in zip(words, bounds, bounds[1:]))
            return
        for word, own, pieces in zip(words, raw, listed):
            self.known[word] = np.array(pieces, dtype=np.int32).tobytes()
            if b"".join(map(self.bytes.__getitem__, pieces)) != own:
                self.altered.add(word)

    def encode(self, spaced: str) -> np.ndarray | None:
        """None where the bytes of the ids are not those of the text."""
        if not self.by_word:
            return _unaltered(np.array(self.model.encode(spaced[1:]), dtype=np.int32), self.bytes, spaced)
        if len(self.known) > CACHED_WORDS:
            self.known, self.altered = dict(self.first), set()
        words = WORD.findall(spaced)
        distinct = set(words)
        if new := distinct.difference(self.known):
            self._learn(list(new))
        if not self.altered.isdisjoint(distinct):
            return None
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.int32)


def _unaltered(ids: np.ndarray, listed: list[bytes], text: str) -> np.ndarray | None:
    return ids if b"".join(map(listed.__getitem__, ids.tolist())) == text.encode() else None


class Side(NamedTuple):
    """One tokenizer: its encoder, and for each id its length and its decimal text within a group and at the end of its part."""

    encode: object
    sizes: np.ndarray
    inner: np.ndarray
    last: np.ndarray


DECIMAL = "S9"  # eight digits, as ids of `SIDE_BITS` have at most, and a mark


def _side(encode, listed: list[bytes], mark: str) -> Side:
    sizes = np.array([len(b) for b in listed], dtype=np.int64)
    return Side(encode, sizes, *[np.array([f"{i}{end}" for i in range(len(listed))], dtype=DECIMAL) for end in (",", mark)])


@lru_cache(maxsize=2)
def sides(byte_file: str, piece_file: str) -> tuple[Side, Side]:
    """Both tokenizers, once per worker."""
    a, b = token_ids(byte_file, special_as_text=True), PieceIds(piece_file)
    to_byte = printed_bytes()
    vocab = a.tokenizer.get_vocab(with_added_tokens=True)
    listed = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        listed[i] = bytes(map(to_byte.get, token)) if all(c in to_byte for c in token) else token.encode()

    def encode(spaced: str) -> np.ndarray | None:  # merges of bytes alter nothing; other files are checked
        return a.encode(spaced) if a.words else _unaltered(a.encode(spaced), listed, spaced)

    return _side(encode, listed, "|"), _side(b.encode, b.bytes, ";")


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every A and every B token, numbered from 0; both sides cut the same bytes, from their start on."""
    ends = np.concatenate([np.cumsum(a_sizes), np.cumsum(b_sizes)])
    starts = ends - np.concatenate([a_sizes, b_sizes])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_sizes)], group[len(a_sizes) :]


def _written(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, a_side: Side, b_side: Side) -> np.ndarray:
    """Decimal ids with the mark that follows each, in the order of `a1,a2|b1;a3|b2,b3`, each padded with zero bytes."""
    n_a, n_b = np.cumsum(in_a), np.cumsum(in_b)
    out = np.empty(len(a) + len(b), dtype=DECIMAL)
    a_before, b_before = np.repeat(n_b - in_b, in_a), np.repeat(n_a, in_b)
    for side, ids, before, last in ((a_side, a, a_before, n_a - 1), (b_side, b, b_before, n_b - 1)):
        place = np.arange(len(ids)) + before
        out[place] = side.inner[ids]
        out[place[last]] = side.last[ids[last]]
    return out


def _digests(
    a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, stops: np.ndarray, a_side: Side, b_side: Side
) -> list[str]:
    """sha256 of `a1,a2|b1;a3|b2,b3` for each text; the groups of text i end before `stops[i]`."""
    digests = [hashlib.sha256() for _ in stops]
    n_a, n_b = np.cumsum(in_a), np.cumsum(in_b)
    text = 0
    for lo in range(0, len(in_a), GROUPS_AT_ONCE):
        hi = min(len(in_a), lo + GROUPS_AT_ONCE)
        a_lo, b_lo = int(n_a[lo] - in_a[lo]), int(n_b[lo] - in_b[lo])
        written = _written(a[a_lo : n_a[hi - 1]], b[b_lo : n_b[hi - 1]], in_a[lo:hi], in_b[lo:hi], a_side, b_side)
        start = lo
        while start < hi:
            stop = min(hi, int(stops[text]))
            first, last = (int(n_a[g] + n_b[g]) - a_lo - b_lo for g in (start, stop - 1))
            joined = written[first - int(in_a[start] + in_b[start]) : last].tobytes().translate(None, b"\0")
            over = stop == stops[text]
            digests[text].update(joined[:-1] if over else joined)
            text += over
            start = stop
    return [d.hexdigest() for d in digests]


def _linked_pairs(a: np.ndarray, b: np.ndarray, ga: np.ndarray, in_b: np.ndarray, text_of_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, id pair and number of links, for every pair that a text holds linked; some links are expanded at a time."""
    first_b, fan = np.cumsum(in_b) - in_b, in_b[ga]
    done, parts = np.cumsum(fan), []
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(done, done[start] - fan[start] + LINKS_AT_ONCE, side="right")))
        own = fan[start:stop]
        row = np.repeat(np.arange(start, stop), own)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        pair = (a[row] << SIDE_BITS) | b[first_b[ga[row]] + nth]
        parts.append(_counted_once(text_of_a[row], pair))
        start = stop
    return _counted(*map(np.concatenate, zip(*parts))) if len(parts) > 1 else parts[0]


def _counted_once(text: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, ...]:
    """`_counted` of single links, by one sort of text and pair in one number where they fit."""
    bits = int(pair.max()).bit_length()
    first = int(text[0])  # texts are in order
    if bits + int(text[-1] - first).bit_length() > 63:
        return _counted(text, pair, np.ones(len(text), dtype=np.int64))
    keys = np.sort(((text - first) << bits) | pair)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    kept = keys[new]
    return (kept >> bits) + first, kept & ((1 << bits) - 1), np.diff(new, append=len(keys))


def _counted(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((pair, text))
    text, pair = text[order], pair[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])]))
    return text[new], pair[new], np.add.reduceat(times[order], new)


def align_texts(texts: list[str | None], a_side: Side, b_side: Side) -> dict[str, list]:
    """The columns of `ALIGNED` for each text. Null and empty texts, and such as a tokenizer alters, have no tokens."""
    rows: dict[str, list] = {name.split()[0]: [0] * len(texts) for name in ALIGNED.split(", ")}
    rows |= {"groups_sha256": [""] * len(texts), "pairs": [np.empty(0, np.int64)] * len(texts), "times": [np.empty(0, np.int64)] * len(texts)}
    kept, a_ids, b_ids = [], [], []
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        a, b = a_side.encode(" " + text), b_side.encode(" " + text)
        if a is not None and b is not None:
            kept.append(i)
            a_ids.append(a.astype(np.int64))
            b_ids.append(b.astype(np.int64))
    if not kept:
        return rows
    n_a, n_b = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
    a, b = np.concatenate(a_ids), np.concatenate(b_ids)
    ga, gb = coalesce(a_side.sizes[a], b_side.sizes[b])  # texts stand one after the other: a text's end is an end of both
    groups = int(ga[-1]) + 1
    in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    stops = ga[np.cumsum(n_a) - 1] + 1
    starts = np.concatenate([[0], stops[:-1]])
    links = np.add.reduceat(in_a * in_b, starts)
    text, pair, times = _linked_pairs(a, b, ga, in_b, np.repeat(np.arange(len(kept)), n_a))
    cut = np.searchsorted(text, np.arange(len(kept) + 1))
    digests = _digests(a, b, in_a, in_b, stops, a_side, b_side)
    for k, i in enumerate(kept):
        own = slice(cut[k], cut[k + 1])
        found = (int(n_a[k]), int(n_b[k]), int(stops[k] - starts[k]), int(links[k]), digests[k], pair[own], times[own])
        for name, value in zip(rows, found):
            rows[name][i] = value
    return rows


def align(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """doc_id with the columns of `ALIGNED`, a row for every row of `docs`; `pairs` holds each linked id pair of a text once.

    A pair's code is its A id times 2 ** 24 plus its B id. Texts are read whole, about a megabyte at a time, so that a task's
    memory follows its longest text; other columns of `docs` are left out, repeated rows and null ids stay.
    """

    def aligned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = sides(byte_file, piece_file)
        for part in parts:
            texts = part["text"].tolist()
            for block in batches_by_size([len(t) if isinstance(t, str) else 0 for t in texts], BATCH_BYTES):
                rows = align_texts(texts[block.start : block.stop], *both)
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[block.start : block.stop].reset_index(drop=True)} | rows)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInPandas(aligned, f"doc_id long, {ALIGNED}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its A id has more)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", SIDE_BITS)))  # at most one row per id of B
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def _scored(shared: Broadcast):
    """Adds the share of one part of the counts to n_best and count_sum."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            listed, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            sizes = np.diff(listed.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            codes = listed.flatten().to_numpy()
            place = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
            here = pairs[place] == codes if len(pairs) else np.zeros(len(codes), dtype=bool)
            place, row, times = place[here], row[here], times[here]
            for name, gained in (("n_best", times * best[place]), ("count_sum", times * counts[place])):
                total = batch.column(name).to_numpy().copy()
                np.add.at(total, row, gained)
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(total, pa.int64()))
            yield batch

    return score


def token_links(docs: DataFrame, byte_file: str, piece_file: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the linked id pairs with their links.

    The texts are encoded once and stored as id pairs. Counts of pairs come from one aggregation that combines before its
    shuffle; they return by broadcast, at most `max_pairs` at a time: where the corpus has more, the stored rows are read
    once for each part, and no row is ever joined. Null and empty texts, and such whose bytes a tokenizer alters, have zeros
    and an empty digest; every row counts as a document; an empty table gives an empty one.
    """
    aligned = stored(align(docs, byte_file, piece_file), "aligned")
    counts = stored(pair_counts(aligned), "pair-counts")
    parts = max(1, -(-counts.count() // max_pairs))
    rows = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for part in range(parts):
        own = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).toPandas().sort_values("pair")
        table = (own["pair"].to_numpy(np.int64), own["n"].to_numpy(np.int64), own["best"].to_numpy(bool))
        rows = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(table)), rows.schema)
        if part < parts - 1:
            rows = stored(rows, "scored")
    return rows


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both public tokenizers over every whole text of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_links(docs, *files).drop("pairs", "times")
