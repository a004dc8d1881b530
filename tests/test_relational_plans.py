"""Joins and functions that must show in the plan, not only in the result."""

from __future__ import annotations

from weftgraph.plans import relational

SF = "/root/testdata/sf0.001"


def plan(spark, name, stage):
    execution = relational.QUERIES[name](spark, SF)._jdf.queryExecution()
    return str(execution.analyzed() if stage == "analyzed" else execution.executedPlan())


def test_plans(spark):
    assert "LateralJoin" in plan(spark, "r_lateral_join", "analyzed")
    assert "parse_json" in plan(spark, "r_parse_json", "analyzed")
    assert "BroadcastNestedLoopJoin" in plan(spark, "r_broadcast_nl_join", "executed") and "BroadcastHashJoin" in plan(spark, "r_broadcast_join", "executed")
    assert "CartesianProduct" in plan(spark, "r_shuffle_replicate_nl_join", "executed")
    assert relational.QUERIES["r_cross_join"](spark, SF).count() == 5 * 25
