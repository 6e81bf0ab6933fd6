"""URL filter: exact membership of URL keys in a list by a cascade of Bloom filters.

Level 0 holds the listed keys, level 1 the corpus keys that level 0 takes for listed, level 2 the listed keys that level 1
takes for such a mistake, and so on until a level makes no mistake. A key of the corpus is asked level by level until one
does not hold it: the parity of that level is the exact answer. The rows are never joined; only the list, and the few corpus
keys that pass a level by mistake, are worked on while the cascade is built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import mix64, stored

MAX_LISTED = 1 << 22  # keys of one cascade; a longer list is split by hash, and the parts are asked one after the other
HASHES = ("_h1", "_h2")


class Level(NamedTuple):
    words: np.ndarray  # the filter's bits, 64 to a word
    probes: int
    salt: int


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias(HASHES[0]), F.xxhash64(key, F.lit("second")).alias(HASHES[1])]


def _bits(h1: np.ndarray, h2: np.ndarray, size: int, probes: int, salt: int) -> np.ndarray:
    """Bit places of every key, a row each; the salt makes the levels independent of each other."""
    step = np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    a = mix64(h1.astype(np.int64).view(np.uint64) ^ step)
    b = mix64(h2.astype(np.int64).view(np.uint64) + step) | np.uint64(1)
    return ((a[:, None] + np.arange(probes, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


def holds(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits = _bits(h1, h2, len(level.words) * 64, level.probes, level.salt)
    return ((level.words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def listed_by(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the corpus is listed: the parity of the first level that does not hold it."""
    depth = np.full(len(h1), len(levels))
    left = np.arange(len(h1))
    for i, level in enumerate(levels):
        held = holds(level, h1[left], h2[left])
        depth[left[~held]] = i
        left = left[held]
    return depth % 2 == 1


def _level(keys: DataFrame, count: int, mistakes: float, salt: int) -> Level:
    """A filter of `count` keys that takes a share of `mistakes` of other keys for its own, put together by the executors."""
    probes = max(1, round(-math.log2(mistakes)))  # mistakes is at most a half
    size = -(-math.ceil(count * probes / math.log(2)) // 64) + 1

    def set_bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bits = _bits(part[HASHES[0]].to_numpy(), part[HASHES[1]].to_numpy(), size * 64, probes, salt).ravel()
            place, row = np.unique(bits >> 6, return_inverse=True)
            words = np.zeros(len(place), dtype=np.uint64)
            np.bitwise_or.at(words, row, np.uint64(1) << (bits & 63).astype(np.uint64))
            yield pd.DataFrame({"place": place, "word": words.view(np.int64)})

    found = keys.select(*HASHES).mapInPandas(set_bits, "place long, word long")
    filled = found.groupBy("place").agg(F.bit_or("word").alias("word")).toPandas()
    words = np.zeros(size, dtype=np.uint64)
    words[filled["place"].to_numpy()] = filled["word"].to_numpy().view(np.uint64)
    return Level(words, probes, salt)


def _held(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, h1.to_numpy(), h2.to_numpy()))

    return keys.filter(test(*HASHES))


def build_cascade(listed: DataFrame, universe: DataFrame, universe_rows: int) -> list[Level]:
    """The cascade that tells the keys of `listed` (key) from all others of `universe` (key, with repeats, never stored).

    The first level is sized so that about as many corpus keys pass it by mistake as are listed; each later one halves what
    is left. It ends with a level that makes no mistake on any key, which is the proof that every answer is right.
    """
    inside = stored(listed.filter("key is not null").distinct().select("key", *hashes(F.col("key"))), "listed")
    count = inside.count()
    if not count:
        return []
    rare = min(0.5, count * math.sqrt(2) / (2 * max(1, universe_rows)))
    levels = [_level(inside, count, rare, 0)]
    passed = _held(universe.filter("key is not null").select("key", *hashes(F.col("key"))), levels[0]).distinct()
    others = stored(passed.join(inside.select("key"), "key", "left_anti"), "mistaken")
    held, asked = others, inside  # what the last level took wrongly for its own, and the keys it encoded
    while wrong := held.count():
        levels.append(_level(held, wrong, 0.5, len(levels)))
        held, asked = stored(_held(asked, levels[-1]), "mistaken"), held
    return levels


def _first_place(shared: Broadcast):
    """Of the arrays of a key's two hashes, the place of the first listed key."""

    @F.pandas_udf("int")
    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in h1], dtype=np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        flat = [np.concatenate([np.empty(0, np.int64), *(x for x in h if x is not None)]) for h in (h1, h2)]
        hit = np.flatnonzero(listed_by(shared.value, *flat))
        found = np.full(len(sizes), -1, dtype=np.int64)
        found[row[hit][::-1]] = (hit - (np.cumsum(sizes) - sizes)[row[hit]])[::-1]  # of a row, the first is written last
        return pd.Series(found).astype("Int32").where(found >= 0)

    return first


def first_listed(rows: DataFrame, candidates: Column, listed: DataFrame, out: str, max_listed: int = MAX_LISTED) -> DataFrame:
    """`rows` with `out`, the place (from 0) of the first of its `candidates`, an array of keys, that `listed` (key) holds.

    Null where none is listed or the array is null or empty; a null candidate counts as the empty key. Up to `max_listed` keys
    the cascade is broadcast (about 15 MB at most); a longer list is cut into parts by hash, with a cascade and a pass each.
    """
    listed = stored(listed.select("key"), "list")
    parts = max(1, -(-listed.count() // max_listed))
    filled = F.transform(candidates, lambda k: F.coalesce(k, F.lit("")))
    universe = rows.select(F.explode(filled).alias("key"))
    universe_rows = rows.agg(F.sum(F.size(candidates))).first()[0] or 0
    places = [f"{out}_part{part}" for part in range(parts)]
    for part, place in enumerate(places):
        own = listed.filter(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)) == part)
        shared = rows.sparkSession.sparkContext.broadcast(build_cascade(own, universe, universe_rows))

        rows = rows.withColumn(place, _first_place(shared)(*[F.transform(filled, which) for which in (lambda k: hashes(k)[0], lambda k: hashes(k)[1])]))
        if parts > 1:
            rows = stored(rows, "places")
    least = F.least(*places) if parts > 1 else F.col(places[0])
    return rows.withColumn(out, least).drop(*places)


A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(column: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    return F.translate(column, A_TO_Z, A_TO_Z.lower())


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and without `://`."""
    url = F.coalesce(url, F.lit(""))
    return lowered(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """What rules could fit: for each shape the last labels of the host with the first characters of the path.

    `(text, kind)` structs, longest text first, then the longer host, then block before allow.
    """
    labels = F.split(host, r"\.", -1)

    def key(n_labels: int, n_path: int) -> Column:
        suffix = F.array_join(F.slice(labels, -n_labels, n_labels), ".")
        text = F.concat(suffix, F.substring(path, 1, n_path))
        fits = (F.size(labels) >= n_labels) & (F.char_length(path) >= n_path)
        return F.when(fits, F.struct(F.char_length(text).alias("size"), F.char_length(suffix).alias("host"), text.alias("text")))

    keys = F.array_compact(F.array(*[key(*shape) for shape in shapes]))
    longest = F.reverse(F.array_sort(keys))
    return F.flatten(
        F.transform(longest, lambda k: F.array(*[F.struct(k["text"].alias("text"), F.lit(v).alias("kind")) for v in ("block", "allow")]))
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], blocked_words: Sequence[str], url: str = "url", max_listed: int = MAX_LISTED
) -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of these names are replaced.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins, of equally long ones that
    with the longer host, then a block. Where no rule fits, a url is blocked if a part of its host (cut at dots and hyphens) is
    one of `blocked_words`, else allowed, a url without a host too. Null urls and such without `://` have an empty host and
    path and no rule. Long urls are judged whole; repeated rows are judged each; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    listed = [(f"{r.verdict} {r.host}{r.path}",) for r in rules] + [(f"word {w}",) for w in blocked_words]
    host, path = url_parts(F.col(url))
    kept = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    fitting = rule_keys(F.col("host"), F.col("path"), shapes)
    words = F.transform(F.split("host", "[.-]", -1), lambda w: F.struct(w.alias("text"), F.lit("word").alias("kind")))
    asked = F.concat(fitting, words) if shapes else words
    rows = rows.withColumn("_asked", asked)
    rows = first_listed(
        rows, F.transform("_asked", lambda k: F.concat_ws(" ", k["kind"], k["text"])),
        spark.createDataFrame(listed, "key string"), "_place", max_listed,
    )
    found = F.get("_asked", F.col("_place"))
    rule = F.when(found["kind"] != "word", found["text"])
    verdict = F.when(found["kind"].isin("block", "word"), "block").otherwise("allow")
    return rows.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


# The rules of the contract, and words of hosts that sell nothing a corpus wants.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
BLOCKED_WORDS = ("ads", "adult", "bets", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of the pages: its host, path, rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, BLOCKED_WORDS).drop("url")


ORACLE = """
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'),
  ('com', '/de/', 'block')
), parts AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fitting AS (
  SELECT p.row, r.host || r.path AS rule, r.verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.row ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN list_has_any(string_split_regex(host, '[.-]'),
    ['ads', 'adult', 'bets', 'casino', 'gambling', 'pills', 'poker', 'porn', 'sex', 'spam', 'viagra', 'xxx'])
  THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting USING (row)
"""
