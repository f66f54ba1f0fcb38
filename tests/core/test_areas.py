"""Queries over very many areas gather no side of a join on the driver for the size of its file."""

import pytest

from loopwright.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plans(spark, run):
    """What run() gives, and the plans of all that it ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = store.executionsList(before, 10000)
    return found, [new.apply(i).physicalPlanDescription() for i in range(new.size())]


@pytest.mark.parametrize("name", ["dist_nearest", "segment_mates", "dist_house_pairs", "solve_partition", "solve_tours"])
def test_no_join_is_broadcast_by_the_size_of_a_file(spark, name):
    rows, told = plans(spark, lambda: QUERIES[name](spark, SF).count())
    assert rows > 0 and any("SortMergeJoin" in plan for plan in told)
    assert not [plan for plan in told if "BroadcastHashJoin" in plan]
