"""Step queries on tables in which one episode holds a third of all steps."""

import duckdb
import pytest

from episodium.plans import catalogue
from tests.oracle import TABLES, compare, connect

NAMES = [
    "w1_hesitance", "w2_flailing", "w3_final_success", "w4_termination", "w9_goal_popping", "s2_parse_episodes",
    "s4_indexed_actions", "s5_null_action", "s6_success_tracker", "p1_instance_metadata", "p9_placeholder_class",
    "j7_pose_matches", "j7_allowed_matches", "j9_allowed_targets", "a16_exclusive_progress", "j8_overlapping_episodes", "j9_nearest_open_target", "j10_distractor_conflicts",
    "a15_zone_progress", "a17_rearrangement_outcome", "m8_collated_batches", "w6_stitched_tokens",
    "w7_assembled_prompts", "t9_encoded_text", "x2_episode_buffer",
]
CHANGES = {
    "lineitem": "* REPLACE (CASE WHEN hash(l_partkey, l_suppkey, l_shipdate) % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey)",
    "conversations": "* REPLACE (CASE WHEN conv_id % 3 = 0 THEN 1 ELSE conv_id END AS conv_id, turn + conv_id * 100 AS turn)",
}


@pytest.fixture(scope="module")
def skewed(folder, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("skewed"))
    for name in TABLES:
        columns = CHANGES.get(name, "*")
        duckdb.sql(f"COPY (SELECT {columns} FROM '{folder}/{name}.parquet') TO '{target}/{name}.parquet'")
    return target


@pytest.mark.parametrize("name", NAMES)
def test_hot_group(spark, skewed, name):
    problem, rows, _, _ = compare(
        spark, connect(skewed), skewed, catalogue.QUERIES[name], catalogue.ORACLES[name]
    )
    assert problem is None
    assert rows > 0
