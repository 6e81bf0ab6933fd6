"""Every registered query against its SQL in DuckDB, and relations between their results."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_queries import ORACLES
from compare_engines import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(entry.board_queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(entry.board_queries()))
def test_query_matches_sql(spark, duck, name):
    rows = entry.queries()[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas", "RoundRobin") if node in plan]
    assert differences(rows, duck, ORACLES[name]) == []


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_counts_add_up(spark):
    def total(name, column="count"):
        return sum(r[column] for r in entry.queries()[name](spark, SF).collect())

    open_count = entry.queries()["pipeline_health"](spark, SF).first().deal_count
    assert total("closure_probability") == open_count
    assert total("opportunity_distribution", "value") == entry.queries()["is_open"](spark, SF).count()
    assert total("stage_counts") <= open_count
    late = entry.queries()["delayed_count"](spark, SF).first().total_delayed_count
    assert total("delayed_by_sector") == total("delayed_by_assignee") == late
    assert total("work_order_status") == entry.queries()["delivery_category"](spark, SF).count()
