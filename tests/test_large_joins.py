"""Tables that grow with the data are shuffled, however small their files look."""

import pytest

from episodium.functions.joins import large
from episodium.plans import catalogue


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_large_side_is_not_broadcast(spark):
    one, two = spark.range(5), spark.range(3)
    assert "BroadcastExchange" in plan(one.join(two, "id"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "BroadcastExchange" not in plan(one.join(large(two), "id", how))


@pytest.mark.parametrize("name", ["j9_allowed_targets", "a17_rearrangement_outcome", "j10_distractor_conflicts", "j9_nearest_open_target"])
def test_goals_send_no_table_through_the_driver(spark, folder, name):
    assert "BroadcastExchange" not in plan(catalogue.QUERIES[name](spark, folder))


def test_nearest_target_sorts_no_pairs(spark, folder):
    assert "SortAggregate" not in plan(catalogue.QUERIES["j9_nearest_open_target"](spark, folder))
