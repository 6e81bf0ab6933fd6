"""One pass per board: leaders beside totals, META beside answers, and the plans that show it."""

from __future__ import annotations

import glob
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyboard.functions.numbers import money_of_list, money_of_parts, money_parts, money_total
from tallyboard.operators import cleaning, deals, quality
from tallyboard.operators.filters import DashboardFilters, filter_deals, filter_work_orders
from tallyboard.operators.shapes import first_of, ranked, with_leaders
from tallyboard.plans import questions
from tallyboard.schemas import DEALS_BOARD, WORK_ORDERS_BOARD
from tallyboard.sources import derived, laid_out
from tallyboard.sources.sinks import stage_table

SF, AS_OF = "/root/testdata/sf0.001", derived.AS_OF


def scans(rows, table):
    lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("FileScan" in line and f"/{table}.parquet" in line for line in lines)


@pytest.mark.parametrize(
    ("name", "orders", "lines"),
    [("top5_share", 1, 0), ("insights", 1, 0), ("insights_filtered", 1, 0), ("forecast_confidence", 1, 0),
     ("forecast_confidence_filtered", 1, 0), ("data_quality_filtered", 1, 1), ("clean_deals", 1, 0), ("clean_work_orders", 0, 1),
     ("clean_board_meta", 1, 1), ("filter_deals", 1, 0)],
)
def test_a_board_is_read_once(spark, name, orders, lines):
    rows = entry.queries()[name](spark, SF)
    assert (scans(rows, "orders"), scans(rows, "lineitem")) == (orders, lines)


@pytest.mark.parametrize("parts", [1, 7])
def test_leaders_and_totals(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice("abc") if i % 3 else "hot", float(rng.randrange(40)), i % 11 > 0) for i in range(900)]
    table = spark.createDataFrame(rows, "id long, grp string, value double, open boolean").repartition(parts)
    leader = F.when(F.col("open"), F.struct("value", "id"))
    found = with_leaders(
        table, [F.col("open").desc(), F.col("value").desc(), F.col("id")], leader, 6,
        money_parts(F.col("value")) | {"n": F.count(F.lit(1))}, {"value": money_of_parts(True), "n": F.sum("n")}, "grp",
    )
    assert "RangePartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    by_group = {r.grp: (r.value, r.n) for r in found.collect()}
    assert by_group == {g: (sum(v for _, x, v, _ in rows if x == g), sum(x == g for _, x, _, _ in rows)) for g in ("a", "b", "c", "hot")}
    first = found.agg(first_of(F.flatten(F.collect_list("leaders")), 6, *deals.BY_VALUE).alias("top")).first().top
    assert [(r.value, r.id) for r in first] == sorted(((v, i) for i, _, v, o in rows if o), key=lambda x: (-x[0], x[1]))[:6]
    assert all(len(r.leaders) <= 6 * parts for r in found.collect())


def test_leaders_of_no_rows(spark):
    none = spark.createDataFrame([], "id string, stage string, value double, expected_close_date date")
    share = deals.top5_share(none).first()
    assert (share.top_value, share.total_value, share.pct) == (0.0, 0.0, 0.0)
    assert [r.rank for r in quality.insights_filtered(none, AS_OF).collect()] == [1, 2]


def test_money_in_parts_and_lists(spark):
    amounts = [0.1] * 7 + [1e18, -3e20, 12345678901.25, None, 0.005]
    table = spark.createDataFrame([(i % 3, a) for i, a in enumerate(amounts)], "part int, a double")
    whole = table.agg(money_total(F.col("a"))).first()[0]
    parts = table.groupBy("part").agg(*[c.alias(n) for n, c in money_parts(F.col("a")).items()])
    assert parts.agg(money_of_parts(True)).first()[0] == whole
    assert table.agg(money_of_list(F.collect_list("a"))).first()[0] == whole
    assert table.filter("a < 0.05").agg(money_of_list(F.collect_list("a"))).first()[0] == pytest.approx(-3e20)


def test_marked_answers_equal_those_of_rows_and_meta(spark):
    flat, orders = derived.flat_deals(spark, SF), derived.flat_work_orders(spark, SF)
    rows, meta = cleaning.clean_flat(flat, DEALS_BOARD).cache(), cleaning.board_meta(flat, DEALS_BOARD).cache()
    marked, late = cleaning.clean_marked(flat, DEALS_BOARD), filter_work_orders(
        cleaning.clean_flat(orders, WORK_ORDERS_BOARD), DashboardFilters(search="wo 1")
    )
    filters = DashboardFilters(search="order 1", owner="Rep 7", start_date="1995-01-01", min_probability=5)
    pairs = [
        (quality.insights(rows, meta, AS_OF), quality.insights_marked(marked, AS_OF)),
        (quality.forecast_confidence(rows, meta), quality.forecast_confidence_marked(marked)),
        (quality.data_quality_filtered(filter_deals(rows, filters), late, meta), quality.data_quality_filtered_marked(marked, filters, late)),
    ]
    for one, other in pairs:
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    board = cleaning.clean_board(derived.deal_items(spark, SF), DEALS_BOARD)
    assert sorted(map(str, board.meta.collect())) == sorted(map(str, meta.collect()))
    assert sorted(map(str, board.rows.collect())) == sorted(map(str, rows.collect()))


def test_notes_have_an_order(spark):
    meta = spark.createDataFrame(
        [("Work Orders", "total_rows", None, 9), ("Work Orders", "missing_field", "assigned_to", 9), ("Deals", "dropped_rows", None, 2),
         ("Deals", "missing_field", "owner", 3), ("Work Orders", "missing_field", "status", 1), ("Deals", "missing_field", "stage", 1),
         ("Deals", "missing_column", "sector", 1), ("Deals", "missing_field", "sector", 9), ("Deals", "total_rows", None, 9)],
        "board string, metric string, field string, count long",
    )
    notes = quality.missing_data_notes(meta).orderBy("rank").collect()
    assert [(r.rank, r.board, r.field) for r in notes] == [
        (1, "Deals", "sector"), (2, "Deals", "stage"), (3, "Deals", "owner"), (4, "Deals", None), (5, "Work Orders", "status"),
        (6, "Work Orders", "assigned_to"),
    ]
    assert quality.missing_data_notes(meta.limit(0)).count() == 0


def months_read(rows, path):
    return {f.split("_month=")[1].split("/")[0] for f in _files(rows) if path in f}


def _files(rows):
    """Files that the scan of a plan opens, after its folders are pruned."""
    plan = rows._jdf.queryExecution().executedPlan()
    [scan] = [leaf for leaf in _leaves(plan) if "FileScan" in leaf.toString()]
    parts = scan.inputRDD().partitions() if hasattr(scan, "inputRDD") else []
    return [f.urlEncodedPath() for p in parts for f in p.files()]


def _leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _leaves(plan.initialPlan())
    children = plan.children()
    if not children.size():
        return [plan]
    return [leaf for i in range(children.size()) for leaf in _leaves(children.apply(i))]


def test_a_range_of_dates_opens_only_its_months(spark, tmp_path):
    days = ["2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", "2023-02-10", None]
    rows = spark.createDataFrame(
        [(str(i), f"d{i}", "s", "Lead", 1.0, 50.0, days[i % 6], f"o{i % 4}") for i in range(600)],
        "id string, name string, sector string, stage string, value double, probability double, expected_close_date string, owner string",
    ).withColumn("expected_close_date", F.col("expected_close_date").cast("date"))
    path = str(tmp_path / "deals")
    laid_out.write_laid_out(rows, laid_out.DEALS_LAYOUT, path)

    def found(**filters):
        return laid_out.filtered_deals(spark, path, DashboardFilters(**filters))

    assert months_read(found(), path) == {"2024-01", "2024-02", "2024-03", "2023-02", "none"}
    assert months_read(found(start_date="2024-02-01", end_date="2024-02-28"), path) == {"2024-02"}
    assert months_read(found(end_date="2024-01-31"), path) == {"2023-02", "2024-01"}
    assert months_read(found(start_date="2024-02-29"), path) == {"2024-02", "2024-03"}
    for filters in ({}, {"start_date": "2024-02-01", "end_date": "2024-02-28"}, {"end_date": "2024-01-31"}, {"start_date": "2024-02-29", "owner": "o3"}):
        expected = filter_deals(rows, DashboardFilters(**filters))
        assert sorted(map(str, found(**filters).collect())) == sorted(map(str, expected.collect()))
    plan = found(owner="o1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(owner,o1)" in plan
    laid_out.write_laid_out(rows.limit(0), laid_out.DEALS_LAYOUT, str(tmp_path / "none"))
    assert laid_out.filtered_deals(spark, str(tmp_path / "none"), DashboardFilters(start_date="2024-01-01")).count() == 0


def test_a_hot_month_is_split(spark, tmp_path):
    """Nine of ten rows share a month; its rows come in several files, each sorted by owner."""
    rows = spark.range(60_000).select(
        F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 512).alias("name"), F.lit("s").alias("sector"), F.lit("Lead").alias("stage"),
        F.lit(1.0).alias("value"), F.lit(1.0).alias("probability"),
        F.when(F.col("id") % 10 > 0, F.lit("2024-05-05")).otherwise("2024-06-06").cast("date").alias("expected_close_date"),
        F.concat(F.lit("o"), F.col("id") % 50).alias("owner"),
    )
    path = str(tmp_path / "deals")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        laid_out.write_laid_out(rows, laid_out.DEALS_LAYOUT, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = glob.glob(f"{path}/expected_close_date_month=2024-05/*.parquet")
    assert len(files) > 2
    owners = [r.owner for r in spark.read.parquet(files[0]).collect()]
    assert owners == sorted(owners)
    assert laid_out.scan_laid_out(spark, path, laid_out.DEALS_LAYOUT).count() == 60_000


def test_ranks_over_many_tasks(spark):
    rows = spark.range(0, 5000, 1, 16).select("id", (F.col("id") * 7919 % 1000).alias("value"))
    wanted = {r.id: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.value, r.id)), 1)}
    ranks = ranked(rows, F.col("value").desc(), F.col("id"))
    assert {r.id: r["rank"] for r in ranks.collect()} == wanted
    assert ranked(rows.limit(0), F.col("id")).count() == 0


def test_messages_with_all_that_their_answer_comes_with(spark):
    said = [(1, 1, "How is the pipeline?"), (1, 2, "Status"), (2, 1, "weekly update please"), (3, 1, None), (4, 1, "who owns it")]
    said = spark.createDataFrame(said, "conversation_id long, turn int, text string")
    schema = "board string, metric string, field string, count long"
    deals_meta = spark.createDataFrame([("Deals", "total_rows", None, 9), ("Deals", "missing_field", "value", 2)], schema)
    orders_meta = spark.createDataFrame([("Work Orders", "total_rows", None, 9), ("Work Orders", "dropped_rows", None, 1)], schema)

    def told(deals_meta, orders_meta):
        b = questions.Business("2026-07-27", None, None, lambda: deals_meta, lambda: orders_meta)
        answers = questions.answer_messages(said, b)
        plan = answers._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
        return {(r.conversation_id, r.turn): (r.route, r.data_complete, r.charts, r.notes) for r in answers.collect()}

    notes = ["Deals board: 2 values missing/malformed in 'value' column.", "Work Orders board: 1 duplicate row(s) dropped."]
    found = told(deals_meta, orders_meta)
    assert found == {
        (1, 1): ("pipeline_summary", False, ["pipeline_stage", "revenue_forecast"], []),
        (1, 2): ("general_business_health", True, None, None),
        (2, 1): ("leadership_summary", False, [], notes),
        (3, 1): ("general_business_health", True, [], []),
        (4, 1): ("owner_analysis", True, [], []),
    }
    whole = told(deals_meta.limit(0), orders_meta.limit(0))
    assert whole[1, 1][1:] == (True, ["pipeline_stage", "revenue_forecast"], []) and whole[2, 1][1:] == (True, [], [])


def test_bars_have_the_order_of_their_chart(spark):
    rows = entry.queries()["answer_charts"](spark, SF).collect()

    def of(chart, metric):
        return [r for r in sorted(rows, key=lambda r: (r.route, r["rank"])) if r.chart == chart and r.metric == metric]

    for chart, metric in (("pipeline_stage", "value"), ("top_deals", "value"), ("work_orders", "count"), ("revenue_forecast", "deal_count")):
        for route in {r.route for r in of(chart, metric)}:
            bars = [r for r in of(chart, metric) if r.route == route]
            assert [r["rank"] for r in bars] == list(range(1, len(bars) + 1))
            if chart in ("pipeline_stage", "top_deals"):
                assert [r.value for r in bars] == sorted((r.value for r in bars), reverse=True)
    assert [r.key for r in of("work_orders", "count")][:5] == ["Completed", "In Progress", "Pending", "Delayed", "Cancelled"]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """Before, they stayed until the driver collected its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)

    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())}

    there = files()
    rows = spark.range(10000).selectExpr("id % 100 as k").repartition(3, "k").groupBy("k").count()
    table = stage_table(rows, "counts")
    for _ in range(50):
        if not (left := {f for f in files() - there if f.startswith("shuffle") and f.endswith(".data")}):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == before and table.count() == 100
