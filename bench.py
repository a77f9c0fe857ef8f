"""Time the headline queries and print one JSON line.

Each query runs to the end into Spark's no-op sink; the first, untimed run of a query warms code
generation and file caches.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from episodium.plans import catalogue  # noqa: E402
from episodium.session import local_session  # noqa: E402

HEADLINE = [
    "a1_task_performance",
    "a5_online_metrics",
    "w1_hesitance",
    "w4_termination",
    "p1_instance_metadata",
    "s2_parse_episodes",
    "l2_stratified_split",
    "l5_batches",
    "j7_pose_matches",
    "m2_action_tokens",
    "m6_target_tokens",
    "m8_collated_batches",
    "w6_stitched_tokens",
    "a13_height_map",
    "a15_zone_progress",
    "t2_nonsense_words",
    "t7_reworded_prompts",
    "t10_textual",
    "t9_corpus_vocabulary",
    "r6_paper_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "episodium-bench")
    times = {}
    for name in wanted:
        run = catalogue.QUERIES[name]
        for _ in range(2):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "headline queries, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
