"""Queries that sort or group whole tables take more partitions when tables grow."""

import pytest

from tidemark.operators import sizes
from tidemark.plans import registry
from tidemark.sources.tables import table


def test_parts(spark, monkeypatch):
    monkeypatch.setattr(sizes, "ROWS", 1000)
    assert [sizes.parts(n, spark) for n in (0, 4000, 4001, 9999)] == [4, 4, 5, 10]


@pytest.mark.parametrize("name", ["one_hop", "call_the_day"])
def test_partitions_follow_the_table(spark, sf, monkeypatch, name):
    monkeypatch.setattr(sizes, "ROWS", 500)
    n = -(-table(spark, sf, "lineitem").count() // 500)
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert n > 4 and sum(line.rstrip().endswith(f", {n}") for line in plan.splitlines() if "RepartitionByExpression" in line) >= 2
