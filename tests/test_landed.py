"""Sums landed in batches against the same reports of all rows at once."""

from __future__ import annotations

import datetime
import glob
import random

import pytest

from tallyboard.operators import both_boards, deals, work_orders
from tallyboard.plans import landed
from tallyboard.plans.landed import LandedSums
from tallyboard.schemas import DEALS, WORK_ORDERS

AS_OF = "2026-07-27"


def boards(spark, rng, ids, note):
    """Rows of both boards with the given ids; a third of them have one sector, owner and assignee."""
    day = datetime.date(2026, 7, 1)

    def picked(*values):
        return rng.choice(values) if rng.random() < 0.67 else values[0]

    def row(fields, i):
        made = {
            "id": i, "name": note, "sector": picked("Mining", "Energy", "", None), "owner": picked("Ann", "Bo", None),
            "stage": picked("Won", "Lost", "Proposal", "Odd", None), "value": picked(0.1, 0.2, None, 1e20, 33.335),
            "assigned_to": picked("Cy", "Di", None), "status": picked("Completed", "In Progress", "Delayed", None),
            "due_date": picked(day + datetime.timedelta(rng.randrange(60)), None),
        }
        return tuple(made.get(f) for f in fields.names)

    return [spark.createDataFrame([row(fields, i) for i in ids], fields) for fields in (DEALS, WORK_ORDERS)]


def shown(rows):
    return sorted(map(str, (r.asDict() for r in rows.select(sorted(rows.columns)).collect())))


def same(sums, d, w):
    assert shown(sums.sector_analysis(AS_OF)) == shown(both_boards.sector_analysis(d, w, AS_OF))
    assert shown(sums.deals_by_owner()) == shown(deals.deals_by_owner(d))
    assert shown(sums.work_orders_by_assignee()) == shown(work_orders.work_orders_by_assignee(w))


def test_two_batches_equal_one_run(spark, tmp_path):
    rng, path = random.Random(7), f"{tmp_path}/sums"
    d1, w1 = boards(spark, rng, [str(i) for i in range(200)] + [None], "first")
    d2, w2 = boards(spark, rng, [str(i) for i in range(150, 400)] + [None], "second")  # 51 ids come again
    sums = LandedSums(spark, path)
    assert sums.batches() == [] and sums.sector_analysis(AS_OF).count() == 0
    sums.land("007", d1, w1)
    same(sums, d1, w1)
    sums.land("008", d2, w2)
    assert sums.batches() == ["007", "008"]
    new = ["id >= '0' and int(id) >= 200"]
    same(sums, d1.unionByName(d2.filter(*new)), w1.unionByName(w2.filter(*new)))
    same(LandedSums(spark, path), d1.unionByName(d2.filter(*new)), w1.unionByName(w2.filter(*new)))
    with pytest.raises(ValueError, match="has been landed"):
        sums.land("008", d2, w2)
    sums.land("009", d2.limit(0), w2.limit(0))  # an empty batch adds nothing
    same(sums, d1.unionByName(d2.filter(*new)), w1.unionByName(w2.filter(*new)))


def test_a_batch_broken_off_does_not_count(spark, tmp_path):
    rng = random.Random(8)
    d1, w1 = boards(spark, rng, ["a", "b", "c"], "first")
    d2, w2 = boards(spark, rng, ["c", "d"], "second")
    sums = LandedSums(spark, f"{tmp_path}/sums")
    sums.land("1", d1, w1)
    with pytest.raises(Exception):
        sums.land("2", d2, w2.drop("id"))  # fails after the deals were written
    assert sums.batches() == ["1"] and glob.glob(f"{tmp_path}/sums/deals-sums/batch=2/*.parquet")
    same(sums, d1, w1)
    sums.land("2", d2, w2)
    same(sums, d1.unionByName(d2.filter("id = 'd'")), w1.unionByName(w2.filter("id = 'd'")))
    with pytest.raises(ValueError, match="folder"):
        sums.land("../3", d2, w2)


def test_reports_read_sums_alone(spark, tmp_path):
    d, w = boards(spark, random.Random(9), ["a", "b"], "only")
    sums = LandedSums(spark, f"{tmp_path}/sums")
    sums.land("1", d, w)
    found = sums.sector_analysis(AS_OF)
    assert len(found.inputFiles()) >= 2 and all("-sums/batch=1/" in file for file in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in plan


def test_a_batch_is_stored_once_and_only_what_is_summed(spark, tmp_path, monkeypatch):
    rng, stored, stage = random.Random(10), [], landed.stage_table
    monkeypatch.setattr(landed, "stage_table", lambda rows, name: stored.append((name, *rows.columns)) or stage(rows, name))
    d1, w1 = boards(spark, rng, ["a", "b", None], "first")
    d2, w2 = boards(spark, rng, ["b", None, "c"], "second")
    sums = LandedSums(spark, f"{tmp_path}/sums")
    sums.land("1", d1, w1)
    sums.land("2", d2, w2)
    deals_columns, orders_columns = ("id", "sector", "owner", "stage", "value"), ("id", "sector", "assigned_to", "status", "due_date")
    assert sorted(stored) == [("landing-deals", *deals_columns)] * 2 + [("landing-orders", *orders_columns)] * 2
    same(sums, d1.unionByName(d2.filter("id = 'c'")), w1.unionByName(w2.filter("id = 'c'")))
