"""Models, search, extraction, sharding, packing and the pipeline."""

from __future__ import annotations

import random
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from brute import benchmark_matches, near_components, without_copies
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyboard.llm import html_text, language_id, packing, quality, registry, sharding, vector_search
from tallyboard.llm.token_ids import TokenIds

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def rows_of(spark, texts, schema="doc_id long, text string, score string, lang_pred string"):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], schema)


# --- models ---


def test_language_on_held_out(spark):
    found = language_id.op3_language_id(spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    held = found.filter("held_out").join(truth, "doc_id").toPandas()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and held["score"].between(0, 1).all()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held["doc_id"])


def test_language_edges(spark):
    known = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language_id.train(known)
    assert model.languages == ["en", "fr"]
    texts = ["the dog", "le chien", None, "", "12 + 3 = 15!", "the cat " * 60_000, "ß"]
    table = rows_of(spark, texts)
    found = language_id.predict(table, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found[:6]] == ["en", "fr", "und", "und", "und", "en"]
    assert [r["score"] for r in found[2:5]] == [0, 0, 0] and all(0 <= r["score"] <= 1 for r in found)
    assert found[0].asDict().keys() == {"doc_id", "text", "score", "lang_pred"}
    untrained = language_id.train(known.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(table, untrained).collect()} == {"und"}
    assert language_id.predict(table.limit(0), model).count() == 0


def test_language_matches_plain_bayes():
    texts = ["Abc déf 12 ghi", "z"]
    model = language_id.LanguageModel(["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(64), 2).T).astype(np.float32), np.zeros(2))
    names, scores = language_id.score_texts(texts, model)
    for text, name, score in zip(texts, names, scores):
        grams = language_id.ngram_buckets(text, 64)
        total = sum(model.weights[g].astype(float) for g in grams) * min(len(grams), language_id.EVIDENCE) / len(grams)
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert name == "ab"[int(np.argmax(total))] and score == pytest.approx(p.max(), rel=1e-3)


def test_quality_on_held_out(spark):
    found = quality.op5_quality(spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality")
    held = found.filter("held_out").join(truth, "doc_id").toPandas()
    good, bad = held["score"][held["quality"] == 1], held["score"][held["quality"] == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.95
    assert found.filter("predicted <> cast(score >= 0.7 as int)").count() == 0


def test_forest_walks_its_trees():
    rng = np.random.default_rng(0)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality.fit_forest(x, y, trees=20, depth=3)
    scores = forest.score(x)
    assert ((scores > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:20], scores):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_edges(spark):
    untrained = quality.train(spark.createDataFrame([], "text string, quality int"))
    found = quality.predict(rows_of(spark, [None, "", "word " * 50_000, "|\n|"]), untrained).collect()
    assert [r["score"] for r in found] == [0.5] * 4 and [r["predicted"] for r in found] == [0] * 4
    one_label = quality.fit_forest(np.zeros((3, 2)), np.ones(3), trees=2)
    assert one_label.score(np.zeros((1, 2)))[0] > 0.9


# --- search ---


def plain_top(rows, k=5):
    out = set()
    for q, v in rows.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows.items() if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k_matches_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = {tuple(r) for r in registry.QUERIES["op1_top_k"](spark, SF).collect()}
    assert got == set(duck.sql(registry.ORACLES["op1_top_k"]).fetchall())


def test_top_k_edges(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(120)] + [(i, [0.5] * 6) for i in range(120, 160)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan")] * 6), (350, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(400, [1.0, 2.0]), (401, [3.0, 4.0]), (450, []), (50, [0.0] * 6), (500, [3e5] * 6), (501, [3e5] * 6)]
    table = vector_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {r["vec_id"]: r["v"] for r in table.collect()}
    assert whole[120] == [128] * 6 and set(whole) & {200, 250, 300, 350} == set()
    found = vector_search.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=20, block_queries=2)
    assert {tuple(r) for r in found.collect()} == plain_top(whole)
    assert vector_search.top_k(table.limit(0), F.lit(True)).count() == 0


def test_tree_boxes_are_tight_and_search_is_exact():
    rng = np.random.default_rng(2)
    ids, vectors = rng.permutation(500), rng.integers(-50, 50, (500, 5))
    tree = vector_search.build_tree(ids, vectors, leaf=8)
    for b, e, low, high in zip(tree.begin, tree.end, tree.low, tree.high):
        assert (tree.vectors[b:e].min(axis=0) == low).all() and (tree.vectors[b:e].max(axis=0) == high).all()
    queries = rng.integers(-50, 50, (20, 5))
    none = np.full(20, np.iinfo(np.int64).min)
    hits = defaultdict(set)
    for q, i, s in vector_search.search_tree(tree, np.arange(1000, 1020), queries, 5, none, np.full(20, vector_search.NO_ID)):
        hits[q - 1000].add((s, i))
    for q in range(20):
        order = np.lexsort((ids, -(vectors @ queries[q])))[:5]
        assert hits[q] == {(int(vectors[r] @ queries[q]), int(ids[r])) for r in order}


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x="</p>";</script></head><body class="no-comments">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a>About</a></ul></nav><div class="cookie-notice">We use</div>
<div id=content><h2>Title &amp; more</h2><p>First <b>bo</b>ld &eacute; para with enough text to be a surge in here, certainly
 eighty   chars.<p class="ad">buy now<p>Second para &lt;b&gt;.<!-- <p>no --><ul><li>one<li>two</ul><form>name</form><p>End.</div>
<div class="comments"><p>Nice post, I really like all of the many things that you are saying here</p></div><footer>&copy;</footer>"""


def test_html_without_article_element():
    wanted = "Title & more\nFirst bold é para with enough text to be a surge in here, certainly eighty chars.\nSecond para <b>.\none\ntwo\nEnd."
    assert html_text.main_text(PAGE) == wanted


def test_html_with_article_element():
    page = "<body><div>Long lead text outside of the article, longer than all that is inside of it together</div><nav>N</nav>"
    page += "<article><header><h1>H</h1></header><p>a<br>b<p>c<aside>no</aside><p>d<script>var x = '<p>'</script></article><p>tail"
    assert html_text.main_text(page) == "H\na b\nc\nd"


def test_html_windows_decide_with_article_elements():
    long = "A sentence of the text that is long enough to make a surge on its own, as paragraphs of articles are."
    two = f"<body><p>x<article><p>{long}</article><nav>N</nav><p>y<p>y<p>y<p>y<article><p>{long}</article>"
    assert html_text.main_text(two) == f"{long}\n{long}"
    stray = f"<main><p>Read on</p><nav>N</nav><nav>N</nav><nav>N</nav><p>{long}<p>{long}<p>{long}</main>"
    assert html_text.main_text(stray) == "\n".join([long] * 3)
    teaser = f"<body><article><p>Teaser</article><nav>N</nav><nav>N</nav><nav>N</nav><div>{long}</div><div>{long}</div><div>{long}</div>"
    assert html_text.main_text(teaser) == "\n".join([long] * 3)


@pytest.mark.parametrize("piece", ["<video-player>", "<audio-x src='a'>", "<template-card>", "<svg width='1'/>", "<svg/>", "<math />", "<SVG a='>'/>"])
def test_html_elements_that_only_look_raw(piece):
    assert html_text.main_text(f"<p>before</p>{piece}<p>after</p>") == "before\nafter"
    assert html_text.main_text("<p>a</p><svg a='/'><text>no</text></svg><video\nsrc=x>no</video><p>b</p>") == "a\nb"


@pytest.mark.parametrize("page", [None, "", "<", "<a href='x", "<p", "&", "<script>", "<!-- x", "<nav>menu</nav>", "</div></div>"])
def test_html_pieces(page):
    assert html_text.main_text(page) in ("", "<", "<p", "&", "<a href='x")


SAID = "This is a sentence of the article that says something of use to readers. " * 3


@pytest.mark.parametrize(
    "page",
    [f"<body><form id=aspnetForm><article><p>{SAID}</p></article><input></form>", f'<div class="content no-sidebar"><p>{SAID}</p></div>',
     f'<div class="ad-free"><article><p>{SAID}</p></article></div>', f'<div class="elementor-widget-container"><p>{SAID}</p></div>',
     f'<article><div class="entry with-comments"><p>{SAID}</p></div></article>', f'<article><div class="social-sciences"><p>{SAID}</p></div></article>',
     f'<div class="promo"><h1>This</h1><p>{SAID}</p></div>', f'<main><div class="notice"><p>{SAID}</p></div></main>',
     f'<article><p>{SAID}<button>Foo</button><select><option>Red</select><span class="share">Share</span></p></article>',
     f'<article><p>{SAID}</p><div class="comments"><article><p>Comment. {SAID * 3}</p></article></div></article>',
     f'<article><p>{SAID}</p></article><div class="related"><article><p>Related. {SAID * 3}</p></article></div>',
     f'<article><p>{SAID}</p><form><p>Form. {SAID * 3}</p></form></article>', f"<p title='a>{SAID}"],
)
def test_html_names_mislead(page):
    assert html_text.main_text(page).removeprefix("This\n") == SAID.strip()


@pytest.mark.parametrize("page", ["<form><p>" + SAID, '<div class="comments"><article><p>' + SAID, '<div class="cookie-notice"><p>' + SAID])
def test_html_furniture_alone_gives_no_text(page):
    assert html_text.main_text(page) == ""


@pytest.mark.parametrize(
    "piece", ["<b ", "<svg x", "<div>", "</b>", '<b "<b >"', "<div class=share>", "<p>x", "<!--", "<svg/>", "<div class=ad><article>", "<b x=\"'>"]
)
def test_html_time_is_linear(piece):
    taken = []
    for n in (20_000, 160_000):
        start = time.process_time()
        html_text.main_text(piece * n + "'")
        taken.append(time.process_time() - start)
    assert taken[1] < 30 * taken[0] + 0.3  # 8 times the text; 64 times if it were quadratic


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, "<p>old", "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert [(r["text"], r["n_chars"]) for r in found] == [("old", 3), ("", 0)] and html_text.extract(pages.limit(0)).count() == 0
    result = registry.QUERIES["op9_html"](spark, SF)
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for row in result.collect():
        article = sources[row["page_id"]].split("<article>")[1].split("</article>")[0]
        assert row["n_chars"] == len(row["text"]) > 0 and "<" not in row["text"]
        assert row["text"].split("\n")[0] == html_text.main_text(article.split("</h1>")[0])


# --- sharding and packing ---


def test_sharding_law(spark):
    found = registry.QUERIES["op4_sharding"](spark, LARGER).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert all(s == len(texts[d].encode()) + 16 and c == zlib.crc32(texts[d].encode()) for d, s, c in found[["doc_id", "size", "text_crc32"]].values)
    by = found.groupby("shard")
    assert sorted(by.groups) == list(range(40)) and all(sorted(x["slot"]) == list(range(len(x))) for _, x in by)
    assert (by["size"].sum() - found["size"].sum() / 40).abs().max() <= found["size"].max()


def test_sharding_splits_a_hot_group(spark):
    rows = [(i, "same text of a large group") for i in range(600)] + [(i, f"text {i}") for i in range(600, 1000)] + [(7, None), (7, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.assign_shards(table, 8).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(found) == 1002 and len(sizes) == 8 and sizes.max() - sizes.min() <= 0.05 * sizes.mean()
    others = found[~found["doc_id"].isin(range(600))].groupby("text_crc32")["shard"].nunique()
    assert others.max() == 1
    assert sharding.assign_shards(table.limit(0), 8).count() == 0
    assert {r["shard"] for r in sharding.assign_shards(table.limit(1), 8).collect()} <= set(range(8))


def test_token_ids_equal_the_tokenizer():
    path = packing.default_vocabulary()
    plain, mine = Tokenizer.from_file(path), TokenIds(path)
    rng = random.Random(6)
    alphabet = "abcXYZ 0189é²¼ß'.,!?|\n\t \xa0\x85\x1c\x7f-_<>" + "sdtrevml'"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    texts += ["日本語 text", "a\0b", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "日<|endoftext|>", "<|ENDOFTEXT|> <|endoftext",  "it's we'll  you've\n\n x", " ", " x", "naïve café ªº × ÷"]
    for text in texts:
        assert mine.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert mine.encode(None).tolist() == []
    assert 50256 in mine.encode("a <|endoftext|> b").tolist()
    assert 50256 not in TokenIds(path, special_as_text=True).encode("a <|endoftext|> b").tolist()


def test_packing_round_trip(spark):
    path = packing.default_vocabulary()
    encoder = TokenIds(path)
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(99)}" for _ in range(rng.choice((1, 30, 200, 900, 3000)))) for _ in range(120)] + [None, "", "x"]
    table = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    for tiers, cell in (((256, 512, 1024, 2048), 1 << 30), ((64, 128), 20_000)):
        found = packing.pack(table, path, tiers, cell, keep_ids=True).toPandas()
        for doc_id, own in found.groupby("doc_id"):
            own = own.sort_values("start")
            ids = np.concatenate([np.frombuffer(b, dtype="<u4") for b in own["ids"]])
            assert ids.tolist() == encoder.encode(texts[doc_id]).tolist() + [1]
            assert (own["start"] == own["length"].cumsum() - own["length"]).all() and (own["doc_tokens"] == len(ids)).all()
        assert set(found["doc_id"]) == set(range(len(texts)))
        assert all(packing.crc32_of(np.frombuffer(b, dtype="<u4")) == c for b, c in zip(found["ids"], found["ids_crc32"]))
        found = found.sort_values(["sequence_id", "offset"])
        by = found.groupby("sequence_id")
        assert (found["offset"] == by["length"].cumsum() - found["length"]).all()
        tokens, padded = by["length"].sum(), by["padded_tokens"].first()
        assert tokens.max() <= tiers[-1] and ((padded == tiers[-1]) | ((tokens & (tokens - 1)) == 0)).all()
        cells = found["sequence_id"].floordiv(1 << 32).nunique()
        assert padded.sum() - tokens.sum() < cells * tiers[-1]
    slim = packing.pack(table, path).toPandas()
    assert slim["ids"].isna().all() and sorted(slim["length"]) == sorted(packing.pack(table, path, keep_ids=True).toPandas()["length"])
    assert packing.pack(table.limit(0), path).count() == 0


# --- pipeline ---


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "x", 0), (900_003, "1234 5678", "en", "x", 9)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    def texts(table):
        return [(r["doc_id"], r["text"]) for r in table.collect()]

    def written(table):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        table.write.parquet(path)
        return spark.read.parquet(path)

    kept = written(stages["language_id"](spark, docs, SF))
    assert {d for d, _ in texts(docs)} - {d for d, _ in texts(kept)} == {900_001, 900_002, 900_003}
    lined = written(stages["line_dedup"](spark, kept, SF))
    before, wanted = dict(texts(kept)), without_copies(texts(kept))
    assert dict(texts(lined)) == {d: t for d, t in wanted.items() if t.strip() or t == before[d]}
    single = written(stages["ngram_jaccard"](spark, lined, SF))
    assert {d for d, _ in texts(single)} == {d for d, (_, c) in near_components(texts(lined)).items() if d == c}
    clean = written(stages["decontamination"](spark, single, SF))
    leaks = {d for d, _ in benchmark_matches(texts(single), items)}
    assert leaks and {d for d, _ in texts(clean)} == {d for d, _ in texts(single)} - leaks
    assert clean.columns == docs.columns
    packed = stages["packing"](spark, clean, SF).toPandas()
    assert set(packed["doc_id"]) == {d for d, _ in texts(clean)} and (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages) and corpus_pipeline.ORACLE_SQL is None


def test_registered_queries():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
