"""Lexical search, URL filter and token alignment against SQL and plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyboard.llm import lexical_search, registry, token_alignment, url_filter

SF = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sql_rows(query, order, **tables):
    duck = duckdb.connect()
    for name, table in tables.items():
        duck.register(name, table.toArrow()) if hasattr(table, "toArrow") else duck.sql(f"create view {name} as select * from '{table}'")
    return duck.sql(f"SELECT {order} FROM ({query})").fetchall()


# --- lexical search ---

HIT = "item_id, rank, doc_id, score"


def test_search_matches_sql(spark):
    want = sql_rows(lexical_search.ORACLE, HIT, documents=f"{SF}/documents.parquet", benchmark=f"{SF}/benchmark.parquet")
    got = [tuple(r) for r in registry.QUERIES["op11_lexical_search"](spark, SF).select(*HIT.split(", ")).collect()]
    assert sorted(got) == sorted(want) and len(got) > 300


@pytest.mark.parametrize("shard_rows, block_bytes", [(8192, 1 << 20), (7, 1 << 20), (50, 60)])
def test_search_edges_in_many_shards_and_blocks(spark, shard_rows, block_bytes):
    rng = random.Random(5)
    words = ["Alpha", "beta", "g4mma", "délta", "ÉPSILON", "zeta_eta", "\x85odd", "the", "THE"]
    texts = [" ".join(rng.choices(words, weights=range(1, 10), k=rng.randrange(1, 30))) for _ in range(250)]
    texts += [None, "", "...", "the " * 20_000, *["alpha the beta"] * 90]
    docs = [(i if i % 31 else None, t, "x") for i, t in enumerate(texts)] + [(7, "alpha the beta", "x")] * 12
    items = [(1, "alpha, alpha THE"), (2, "délta zeta eta"), (3, None), (4, "--"), (5, "unheard of"), (None, "the"), (1, "alpha, alpha THE")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(8)
    items = spark.createDataFrame(items, "item_id long, text string")
    found = lexical_search.rank_documents(docs, items, shard_rows=shard_rows, block_bytes=block_bytes)
    want = sql_rows(lexical_search.ORACLE, HIT, documents=docs, benchmark=items)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert {r[0] for r in want} == {1, 2, None}


def test_search_of_empty_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert lexical_search.rank_documents(docs.limit(0), items).count() == 0
    assert lexical_search.rank_documents(docs, items.limit(0)).count() == 0


def test_term_bytes_are_the_terms_of_the_pattern():
    text = "".join(map(chr, [*range(0x300), 0x2028, 0x4E2D, 0x1F600])) + "aB9_c-É"
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    plain = [re.sub("[A-Z]", lambda m: m.group().lower(), w).encode() for w in pattern.findall(text)]
    assert lexical_search.terms_of(text) == plain


def test_bounds_hold_and_prune():
    """No document scores above the bound of any node over it, and close copies of the query let most leaves be."""
    rng = np.random.default_rng(2)
    width, docs = 400, 3000
    centres = [rng.choice(width, 25, replace=False) for _ in range(60)]
    terms = [np.unique(np.concatenate([centres[i % 60], rng.choice(width, 2)])) for i in range(docs)]
    sizes = np.array([len(t) for t in terms])
    values = 500_000 + rng.integers(-5000, 5000, sizes.sum())
    weights = lexical_search.term_weights(docs, int(sizes.sum()) * 3, np.bincount(np.concatenate(terms), minlength=width))
    tree = lexical_search.build_tree(np.arange(docs), sizes, np.concatenate(terms), values, weights.scale)
    queries = lexical_search.Queries([0], {}, [centres[7]], [np.ones(25, dtype=np.int64)])
    group = lexical_search.Group(queries, range(1), weights)
    bounds = group.bounds(tree)[:, 0]
    query = np.zeros(width, dtype=np.int64)
    query[centres[7]] = weights.weight[centres[7]]
    scores = np.add.reduceat(query[tree.terms] * tree.values, tree.start[:-1])
    assert all(bounds[i] >= scores[b:e].max() for i, (b, e) in enumerate(zip(tree.begin, tree.end)))
    assert sorted(tree.ids) == list(range(docs)) and (tree.end - tree.begin)[tree.child < 0].max() <= lexical_search.LEAF
    best = [lexical_search.Best(10, (0, 0))]
    assert group.search(tree, best) < docs / 2
    assert sorted(best[0].heap, reverse=True) == sorted(zip(scores.tolist(), (-tree.ids).tolist()), reverse=True)[:10]


def test_values_beyond_64_bits():
    weights = lexical_search.Weights(10**11, 10**15, np.array([1]))
    assert lexical_search._values(np.array([10**8]), np.array([1]), np.array([3]), weights).tolist() == [
        3 * 10**9 // (3000 + 8 * (25 + 75 * 10**8 * 10**11 // 10**15))
    ]


# --- URL filter ---

JUDGED = "page_id, host, path, rule, verdict"
URLS = [
    None, "", "example.org/es/", "http://", "http:///org/", "https://EXAMPLE.org/es/x?y#z", "http://example.org/en/1", "http://a.b.example.org/en/137",
    "http://example.org", "http://org/", "http://xorg/", "http://notexample.org/es/", "ftp://a.com/fr/", "ftp://a.com/fr", "http://a.com/de/?q=://b.org/",
    "http://a.com#/de/", "http://a.com:80/de/", "http://casino.example.net/", "http://my-casino.org/x", "http://my.casino-win.com/fr/x", "http://mycasino.net/",
    "x://É.Com/de/", "http://a..org/", "http://.org/", "http://org./", "http://a.org\n/es/", "http://a.net/" + "x" * 200_000, "http://" + "a." * 5000 + "com/de/",
]


def test_urls_match_sql(spark):
    want = sql_rows(url_filter.ORACLE, JUDGED, pages=f"{SF}/pages.parquet")
    got = registry.QUERIES["op12_url_filter"](spark, SF).select(*JUDGED.split(", "))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}


def test_url_edges(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(5, URLS[5], "h", "v"), (None, URLS[5], "h", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    found = url_filter.judge_urls(pages, url_filter.RULES, url_filter.BLOCKED_WORDS)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = sql_rows(url_filter.ORACLE, JUDGED, pages=pages.select("page_id", "url"))
    got = [tuple(r) for r in found.drop("url").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES, url_filter.BLOCKED_WORDS).count() == 0
    bare = url_filter.judge_urls(pages, (), ()).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in bare] == [(None, "allow")]


def test_equal_rules_and_lengths(spark):
    pages = spark.createDataFrame([(1, "http://a.bc/de"), (2, "http://x.a.bc/"), (3, "http://q.rs/")], "page_id long, url string")
    rules = [url_filter.Rule(*r) for r in (("a.bc", "/", "allow"), ("bc", "/de", "block"), ("q.rs", "", "allow"), ("q.rs", "", "block"))]
    got = url_filter.judge_urls(pages, rules, ()).orderBy("page_id").select("rule", "verdict").collect()
    assert [tuple(r) for r in got] == [("a.bc/", "allow"), ("a.bc/", "allow"), ("q.rs", "block")]


@pytest.mark.parametrize("max_listed", [1 << 22, 150])
def test_cascade_is_exact_over_all_keys(spark, max_listed):
    """The levels leave no mistake, whatever their size; a list in parts gives the same places."""
    rng = random.Random(1)
    listed = [(f"k{i * 7}",) for i in range(400)] + [("k0",), (None,)]
    rows = [(i, [f"k{rng.randrange(6000)}" for _ in range(rng.randrange(6))]) for i in range(3000)] + [(-1, None), (-2, ["x", None, "k7"])]
    table = spark.createDataFrame(rows, "id long, keys array<string>")
    got = url_filter.first_listed(table, F.col("keys"), spark.createDataFrame(listed, "key string"), "place", max_listed)
    known = {k for k, in listed} - {None}
    want = {i: next((n for n, k in enumerate(keys or []) if k in known), None) for i, keys in rows}
    assert {r["id"]: r["place"] for r in got.collect()} == want


def test_cascade_alternates(spark):
    """Filters of the size for few corpus keys make mistakes among many; deeper levels settle every one."""
    listed = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.build_cascade(listed, universe, 500)
    assert len(levels) > 3
    hashed = universe.select("key", *url_filter.hashes(F.col("key"))).toPandas()
    found = url_filter.listed_by(levels, hashed["_h1"].to_numpy(), hashed["_h2"].to_numpy())
    assert {k for k, f in zip(hashed["key"], found) if f} == {f"k{i}" for i in range(500)}
    assert url_filter.build_cascade(listed.limit(0), universe, 10) == []
    assert not url_filter.listed_by([], np.array([1]), np.array([2])).any()


# --- token alignment ---


def plain_alignment(docs):
    """{doc_id: columns} by cutting at the byte offsets where tokens of both sides end."""
    byte_bpe, pieces = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    byte_bpe.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found, links, counts = {}, {}, Counter()
    for doc_id, text in docs:
        found[doc_id], links[doc_id] = (0, 0, 0, 0, ""), []
        if not text:
            continue
        a = [(i, bytes(byte_of[c] for c in byte_bpe.id_to_token(i))) for i in byte_bpe.encode(" " + text, add_special_tokens=False).ids]
        named = [(i, pieces.id_to_piece(i)) for i in pieces.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i, p in named]
        if {b"".join(x for _, x in side) for side in (a, b)} != {(" " + text).encode()}:
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(([x for x, _ in a[i:i2]], [x for x, _ in b[j:j2]]))
            i, j = i2, j2
        links[doc_id] = [(x, y) for xs, ys in groups for x in xs for y in ys]
        counts.update(set(links[doc_id]))
        written = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        found[doc_id] = (len(a), len(b), len(groups), len(links[doc_id]), hashlib.sha256(written.encode()).hexdigest())
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return {
        d: (*row[:4], sum(counts[p] == top[p[0]] for p in links[d]), sum(counts[p] for p in links[d]), row[4]) for d, row in found.items()
    }


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(table):
    return {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in table.collect()}


def test_alignment_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(registry.QUERIES["op13_token_alignment"](spark, SF)) == plain_alignment(docs)


def odd_texts():
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "a", "the", "Ünder", "中文字", "é", "é", "🙂", "👩‍👩‍👧", "<s>", "</s>", "<unk>", "<|endoftext|>", "12345", "don't", "\x00", "\x7f", "'ll", "ﬁ", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(150)]
    texts += [None, "", " ", "   ", "x ", " x", "a\u2581b", "\u2581", "<0x0A>", "word " * 9000, "z" * 5000, "中" * 2000, "<|endoftext|>", "\ufeff"]
    return texts + texts[:9]


@pytest.mark.parametrize("max_pairs", [1 << 22, 100])
def test_alignment_edges(spark, max_pairs, monkeypatch):
    docs = list(enumerate(odd_texts()))
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n_a string, pairs int").repartition(3)
    got = aligned(token_alignment.token_links(table, *FILES, max_pairs=max_pairs))
    assert got == plain_alignment(docs)
    assert got[150] == got[151] == got[156] == (0, 0, 0, 0, 0, 0, "")
    assert token_alignment.token_links(table.limit(0), *FILES).count() == 0


def test_alignment_in_small_steps(monkeypatch):
    both = token_alignment.sides(*FILES)
    whole = token_alignment.align_texts(odd_texts(), *both)
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", 5)
    monkeypatch.setattr(token_alignment, "GROUPS_AT_ONCE", 7)
    stepped = token_alignment.align_texts(odd_texts(), *both)
    for name in whole:
        assert all(np.array_equal(x, y) for x, y in zip(whole[name], stepped[name])), name


def test_groups_break_where_both_sides_end():
    ga, gb = token_alignment.coalesce(np.array([2, 3, 1, 4]), np.array([5, 2, 3]))
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 1, 1]


def test_weights_are_those_of_the_formula():
    weights = lexical_search.term_weights(1000, 5, np.array([0, 1, 999, 1000]))
    assert weights.weight.tolist() == [math.floor(1000 * math.log(2002 / (2 * f + 1))) for f in (0, 1, 999, 1000)]
