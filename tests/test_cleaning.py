"""Flattening, aliases, deduplication under skew, and the sources and sinks."""

from __future__ import annotations

import csv
import glob
import gzip
import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import golden
from tallyboard.operators import cleaning, messages
from tallyboard.schemas import DEALS, DEALS_BOARD, WORK_ORDERS_BOARD, BoardSpec
from tallyboard.sources import boards, derived, sinks

SF = "/root/testdata/sf0.001"


def flat_one(spark, cells):
    item = [(0, " i1 ", " n ", [(None, title, text, None) for title, text in cells])]
    return cleaning.flatten_items(spark.createDataFrame(item, golden.ITEM), DEALS_BOARD).first()


def test_last_alias_with_text_wins(spark):
    row = flat_one(spark, [("Owner", "a"), ("Owner code", "b"), ("Owner Code", None)])
    assert (row.id, row.name, row.owner) == ("i1", "n", "b")


def test_empty_text_overrides(spark):
    assert flat_one(spark, [("Owner", "a"), ("Owner code", " ")]).owner == ""


def test_last_cell_of_a_title_wins_even_when_null(spark):
    assert flat_one(spark, [("Stage", "Lead"), (" Stage ", None)]).stage is None
    assert flat_one(spark, [("Stage", "Lead"), ("", "x"), (None, "y"), ("Stage", "Won")]).stage == "Won"


def test_titles_are_exact_for_values_but_not_for_presence(spark):
    row = flat_one(spark, [("STAGE", "Lead")])
    assert row.stage is None
    assert row.titles_present == 1 << DEALS_BOARD.fields.index("stage")


def test_flattening_gives_the_flat_rows(spark):
    for items, flat, spec in (
        (derived.deal_items, derived.flat_deals, DEALS_BOARD),
        (derived.work_order_items, derived.flat_work_orders, WORK_ORDERS_BOARD),
    ):
        expected = flat(spark, SF)
        actual = cleaning.flatten_items(items(spark, SF), spec).select(expected.columns)
        assert actual.exceptAll(expected).count() == 0 and expected.exceptAll(actual).count() == 0


def skewed(spark, n=20000):
    """A third of all rows share one id; the first of them comes last in the input."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        (F.lit(n) - F.col("id")).alias("seq"),
        F.when(hot, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("n").alias("name"),
        *[F.col("id").cast("string").alias(f) for f in DEALS_BOARD.fields],
        F.lit(63).cast("long").alias("titles_present"),
    )


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_unique_ids_are_neither_shuffled_nor_sorted(spark):
    first = cleaning.dedupe_items(skewed(spark))
    plan = plan_of(first)
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1 and "Sort" not in plan and "Window" not in plan
    assert first.filter("id = 'hot'").first().value == "19998"
    unique = cleaning.dedupe_items(skewed(spark).filter("id <> 'hot'"))
    assert "Exchange" not in plan_of(unique) and unique.count() == 20000 - len(range(0, 20000, 3))


def test_many_repeated_ids_are_limited_before_the_shuffle(spark):
    first = cleaning.dedupe_items(skewed(spark), limit=0)
    assert plan_of(first).count("WindowGroupLimit") == 2 and "Partial" in plan_of(first)
    assert first.filter("id = 'hot'").first().value == "19998"


@pytest.mark.parametrize("limit", [cleaning.REPEATED_IDS, 2])
def test_first_rows_count_copies_and_break_ties(spark, limit):
    rows = [(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (5, "c", "p"), (5, "c", "q"), (5, "c", "r"), (6, "c", "s"),
            (4, None, "n"), (7, None, "m"), (8, "", "e")]
    flat = spark.createDataFrame(rows, "seq long, id string, text string").repartition(4)
    found = {r.id: (r.seq, r.text, r.copies) for r in cleaning.first_rows(flat, limit).collect()}
    assert found.pop("c") in [(5, t, 4) for t in "pqr"]
    assert found == {"a": (1, "y", 2), "b": (2, "z", 1), None: (4, "n", 2), "": (8, "e", 1)}
    assert cleaning.first_rows(flat, limit).count() == 5
    assert cleaning.first_rows(flat.limit(0), limit).count() == 0
    long = flat.withColumn("id", F.repeat("id", 300))
    assert {r.copies for r in cleaning.first_rows(long, limit).collect()} == {1, 2, 4} and cleaning.first_rows(long, limit).count() == 5


def test_many_repeated_ids_shuffle_their_rows_once(spark):
    few, many = cleaning.first_rows(skewed(spark)), cleaning.first_rows(skewed(spark), limit=0)
    plan = plan_of(many)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert "Join" not in plan_of(cleaning.dedupe_items(skewed(spark), limit=0))
    assert many.columns == few.columns and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    rows = spark.createDataFrame([(None, "a", "x"), (1, "a", "y"), (2, "b", None)], "seq long, id string, text string")
    assert sorted((r.id, r.text, r.copies) for r in cleaning.first_rows(rows, limit=0).collect()) == [("a", "x", 2), ("b", None, 1)]


def test_marks_under_skew(spark):
    marked = cleaning.clean_marked(skewed(spark), DEALS_BOARD)
    hot = marked.filter("id = 'hot'").first()
    assert (hot.copies, hot.value, hot.seq) == (len(range(0, 20000, 3)), 19998.0, 2)
    meta = {(r.metric, r.field): r["count"] for r in cleaning.meta_of_marks(marked, DEALS_BOARD).collect()}
    assert meta == {(r.metric, r.field): r["count"] for r in cleaning.board_meta(skewed(spark), DEALS_BOARD).collect()}


def test_meta_counts_under_skew(spark):
    meta = {(r.metric, r.field): r["count"] for r in cleaning.board_meta(skewed(spark), DEALS_BOARD).collect()}
    hot = len(range(0, 20000, 3))
    assert meta[("total_rows", None)] == 20000
    assert meta[("dropped_rows", None)] == hot - 1


def test_scan_orders_pages_and_lifts_titles(spark, tmp_path):
    def item(i):
        return {"id": str(i), "name": f"n{i}", "column_values": [
            {"id": "s", "column": {"title": "Stage"}, "text": "Lead", "value": None},
            {"id": "o", "title": "Owner", "text": "Ann", "value": None}]}

    first = {"data": {"boards": [{"items_page": {"cursor": "c", "items": [item(0), item(1)]}}]}}
    later = {"data": {"next_items_page": {"cursor": "d", "items": [item(2)]}}}
    nothing = {"data": {"next_items_page": {"cursor": None, "items": []}}}
    for n, page in enumerate((first, later, nothing)):
        page["page"] = n
        (tmp_path / f"page-{n:05d}.json").write_text(json.dumps(page, indent=1))
    items = boards.scan_board_pages(spark, str(tmp_path), multi_line=True)
    assert [r.id for r in items.orderBy("seq").collect()] == ["0", "1", "2"]
    flat = cleaning.flatten_items(items, DEALS_BOARD).first()
    assert (flat.stage, flat.owner) == ("Lead", "Ann")


def page_of(number, *ids, first=False, cursor=None):
    items = {"cursor": cursor, "items": [{"id": i, "name": "n", "column_values": []} for i in ids]}
    return {"page": number, "data": {"boards": [{"items_page": items}]} if first else {"next_items_page": items}}


def landed(folder, *pages):
    for i, page in enumerate(pages):
        (folder / f"{i}.json").write_text(page if isinstance(page, str) else json.dumps(page))
    return str(folder)


def test_pages_in_order_of_their_ordinal(spark, tmp_path):
    (tmp_path / "page-4.json").write_text(json.dumps(page_of(4, "a", "b")))
    (tmp_path / "page-2.json").write_text(
        json.dumps(page_of(2, "b", "a", first=True, cursor="x")) + "\n" + json.dumps(page_of(3, "c", cursor="y"))
    )
    items = boards.scan_board_pages(spark, str(tmp_path))
    assert [(r.page, r.pos, r.id) for r in items.orderBy("seq").collect()] == [
        (2, 0, "b"), (2, 1, "a"), (3, 0, "c"), (4, 0, "a"), (4, 1, "b"),
    ]
    first = cleaning.dedupe_items(cleaning.flatten_items(items, DEALS_BOARD)).orderBy("seq").collect()
    assert [r.id for r in first] == ["b", "a", "c"]


@pytest.mark.parametrize(
    "bad",
    ['{"page": 1, "data": {"next_items_page": {"items": [{"id": "x"', '{"page": 1, "errors": [{"message": "no"}]}',
     '{"page": 1, "data": {"next_items_page": {"cursor": "c"}}}', '{"data": {"next_items_page": {"items": []}}}'],
)
def test_a_bad_page_fails_or_is_counted(spark, tmp_path, bad):
    path = landed(tmp_path, page_of(0, "a", first=True), bad)
    with pytest.raises(Exception, match="bad page"):
        boards.scan_board_pages(spark, path).collect()
    assert [r.id for r in boards.scan_board_pages(spark, path, skip_bad=True).collect()] == ["a"]
    assert {r.metric: r["count"] for r in boards.page_meta(spark, path, "Deals").collect()} == {"unreadable_pages": 1, "missing_pages": 0}


START, END = page_of(0, "a", first=True, cursor="x"), page_of(3, "d")
MIDDLE = [page_of(1, "b", cursor="y"), page_of(2, "c", cursor="z")]


@pytest.mark.parametrize(
    ("pages", "missing", "left"),
    [
        ([START, MIDDLE[0], END], 1, "abd"),
        ([START, END], 2, "ad"),
        ([START, *MIDDLE], 1, "abc"),
        ([*MIDDLE, END], 1, "bcd"),
        ([MIDDLE[0]], 2, "b"),
        ([START, *MIDDLE, '{"page": 3, "errors": []}'], 1, "abc"),
    ],
)
def test_missing_pages_fail_or_are_counted(spark, tmp_path, pages, missing, left):
    path = landed(tmp_path, *pages)
    with pytest.raises(Exception, match="missing pages|bad page"):
        boards.scan_board_pages(spark, path).collect()
    items = boards.scan_board_pages(spark, path, skip_bad=True)
    assert "".join(r.id for r in items.orderBy("seq").collect()) == left
    assert boards.page_meta(spark, path, "Deals").filter("metric = 'missing_pages'").first()["count"] == missing


@pytest.mark.parametrize(
    ("pages", "told"),
    [
        ([START, *MIDDLE, END, MIDDLE[1]], "1 repeated page ordinals"),
        ([START, page_of(1, "b", first=True, cursor="y"), MIDDLE[1], END], "2 first pages"),
        ([START, page_of(1, "b"), MIDDLE[1], END], "a last page before page 3"),
        ([START, page_of(1, "b"), MIDDLE[1]], "a last page before page 2"),
    ],
)
@pytest.mark.parametrize("skip_bad", [False, True])
def test_pages_that_are_no_chain_fail(spark, tmp_path, pages, told, skip_bad):
    path = landed(tmp_path, *pages)
    with pytest.raises(Exception, match=told):
        boards.scan_board_pages(spark, path, skip_bad=skip_bad).select("id").collect()


def test_a_whole_chain_and_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    path = landed(tmp_path, *MIDDLE, END, START)
    chain = boards.page_chain(spark, path, "Deals").first()
    assert (chain.pages, chain.least, chain.greatest, chain.missing_pages, chain.repeated_pages) == (4, 0, 3, 0, 0)
    assert boards.scan_board_pages(spark, path).count() == 4
    assert boards.scan_board_pages(spark, str(tmp_path / "none")).count() == 0


def test_landed_pages_are_a_chain_in_order(spark, tmp_path):
    items = derived.deal_items(spark, SF)
    for size in (7, 10_000):
        path = str(tmp_path / str(size))
        derived.land_pages(items, F.col("seq"), path, size)
        found = boards.scan_board_pages(spark, path).orderBy("seq").collect()
        assert [r.id for r in found] == [r.id for r in items.orderBy("seq").collect()]
        assert max(r.pos for r in found) == min(size, len(found)) - 1


def test_landing_writes_cells_once_and_compressed(spark, tmp_path):
    """Rows are sorted and brought together without their cells; what is stored stays far below the size of the pages."""
    for raw, cells, nested in (
        (derived.raw_deals, derived.DEAL_CELLS, derived.deal_items),
        (derived.raw_work_orders, derived.ORDER_CELLS, derived.work_order_items),
    ):
        path, items = str(tmp_path / raw.__name__), nested(spark, SF)
        with sinks.temporary_tables(spark) as held:
            derived.land_pages(raw(spark, SF), F.col("seq"), path, cells=cells)
            [sorted_items] = held.paths
            assert "column_values" not in spark.read.parquet(sorted_items).columns
        files = glob.glob(f"{path}/part-*")
        assert files and all(f.endswith(".json.gz") for f in files)
        text = sum(len(gzip.open(f).read()) for f in files)
        assert 5 * sum(os.path.getsize(f) for f in files) < text
        found = boards.scan_board_pages(spark, path).orderBy("seq").collect()
        wanted = items.orderBy("seq").collect()
        assert [(r.page, r.pos) for r in found] == [divmod(i, derived.PAGE_ITEMS) for i in range(len(wanted))]
        assert sorted((r.id, r.name, str([tuple(c) for c in r.column_values])) for r in found) == sorted(
            (r.id, r.name, str([tuple(c) for c in r.column_values])) for r in wanted
        )


def test_pretty_printed_pages_of_both_boards(spark, tmp_path):
    for name in ("deals", "orders"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.json").write_text(json.dumps(page_of(0, name, first=True), indent=2))
    both = boards.load_boards(spark, str(tmp_path / "deals"), str(tmp_path / "orders"), multi_line=True)
    assert (both.deals.first().id, both.work_orders.first().id) == ("deals", "orders")


def test_names_with_quotes(spark):
    spec = BoardSpec(board="Bob's", aliases=(("It's", "sector"),), text=("sector",))
    flat = spark.createDataFrame([(1, "a", "n", None, 0)], "seq long, id string, name string, sector string, titles_present long")
    assert {r.board for r in cleaning.board_meta(flat, spec).collect()} == {"Bob's"}


def test_sample_and_columns(spark):
    items = golden.deal_items(spark)
    assert {r.id for r in boards.sample_items(items, "Deals").collect()} == {"d1", "d2", "d3"}
    columns = {r.title: r.items_with_value for r in boards.board_columns(items, "Deals").collect()}
    assert columns["Stage"] == 10 and columns["Value"] == 9


def test_csv_quotes_everything(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi"', None, 1.0), ("a,b", "", 2.5)], "a string, b string, c double").coalesce(1)
    path = str(tmp_path / "out")
    sinks.write_csv(rows, path)
    [part] = glob.glob(path + "/part-*.csv")
    lines = open(part).read().splitlines()
    assert sorted(lines) == sorted(['"a","b","c"', '"say ""hi""","","1.0"', '"a,b","","2.5"'])
    assert [r[0] for r in csv.reader(lines)] == ["a", 'say "hi"', "a,b"]


def test_records_keep_nulls(spark, tmp_path):
    path = str(tmp_path / "records")
    sinks.write_records(spark.createDataFrame([("x", None)], "a string, b string").coalesce(1), path)
    [part] = glob.glob(path + "/part-*.json")
    assert json.loads(open(part).read()) == {"a": "x", "b": None}


def test_clean_tables_push_filters_down(spark, tmp_path):
    path = str(tmp_path / "deals")
    cleaning.clean_flat(derived.flat_deals(spark, SF), DEALS_BOARD).write.parquet(path)
    won = boards.scan_table(spark, path, DEALS).filter("stage = 'Won'").select("value")
    plan = won._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stage,Won)" in plan and "ReadSchema: struct<stage:string,value:double>" in plan


def test_stored_tables_go_with_their_block(spark):
    with sinks.temporary_tables(spark):
        table = sinks.stage_table(spark.range(5), "numbers")
        [path] = {os.path.dirname(f.replace("file://", "")) for f in table.inputFiles()}
        assert table.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def place_of(table):
    [path] = {os.path.dirname(f.replace("file://", "")) for f in table.inputFiles()}
    return path


def test_blocks_remove_only_what_is_theirs(spark):
    before = sinks.stage_table(spark.range(3), "mine")
    with sinks.temporary_tables(spark):
        outer = sinks.stage_table(spark.range(4), "outer")
        with sinks.temporary_tables(spark):
            [inner, other] = sinks.stage_tables(inner=spark.range(5), other=spark.range(6))
        kept = sinks.StoredTables(spark)
        with kept:
            held = sinks.stage_table(spark.range(7), "held")
        assert outer.count() == 4 and held.count() == 7
        assert not os.path.exists(place_of(inner)) and not os.path.exists(place_of(other))
    assert before.count() == 3 and held.count() == 7 and not os.path.exists(place_of(outer))
    kept.close()
    assert not os.path.exists(place_of(held)) and before.count() == 3


def test_blocks_of_two_threads(spark):
    def work(n, first, second):
        with sinks.temporary_tables(spark):
            table = sinks.stage_table(spark.range(n), f"thread-{n}")
            first.set()
            second.wait(60)
            return table.count(), place_of(table)

    events = threading.Event(), threading.Event()
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(work, 5, events[0], events[1]), pool.submit(work, 6, events[1], events[0])]
        found = [job.result() for job in jobs]
    assert [n for n, _ in found] == [5, 6] and not any(os.path.exists(path) for _, path in found)


def test_staging_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    assert sinks.shared_folder(spark)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_folder(Cluster())


@pytest.mark.parametrize(
    ("said", "route", "vague"),
    [
        ("how is pipeline this quarter?", "pipeline_summary", False),
        ("what is the status?", "general_business_health", False),
        (" Status ", "general_business_health", True),
        ("weekly update on sales", "leadership_summary", False),
        ("please stop", "top_deals", False),
        ("compare owners", "pipeline_vs_work_orders", False),
        ("who owns the overdue work order", "owner_analysis", False),
        ("hello", "general_business_health", False),
    ],
)
def test_routes(spark, said, route, vague):
    row = messages.route_messages(spark.createDataFrame([(1, 1, said)], "conversation_id long, turn int, text string")).first()
    assert (row.route, row.is_ambiguous) == (route, vague)


def test_recent_turns(spark):
    turns = spark.range(100).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conversation_id"),
        F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"),
    )
    last = messages.recent_turns(turns, 3)
    assert sorted(r.turn for r in last.filter("conversation_id = 0").collect()) == [93, 96, 99]
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("salts", [None, 1, 7])
def test_many_recent_turns_of_a_hot_conversation(spark, salts):
    turns = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 400).when(F.col("id") % 3 == 1, 1).alias("conversation_id"),
        F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"), F.lit(0).alias("salt"),
    )
    last = messages.recent_turns(turns.repartition(5), 5000, salts)
    assert last.columns == ["conversation_id", "turn", "role", "text"]
    found = last.toPandas()
    mine = turns.toPandas().sort_values("turn").groupby("conversation_id", dropna=False).tail(5000)
    assert sorted(found["turn"]) == sorted(mine["turn"]) and found["conversation_id"].isna().sum() == 5000
    assert messages.recent_turns(turns.limit(0), 5000, salts).count() == 0


def test_salts_balance_parts_and_what_they_leave():
    assert [messages.salts_for(m, 5000) for m in (0, 1, 5000, 20_001, 3 * 10**10)] == [1, 1, 1, 3, 2450]
