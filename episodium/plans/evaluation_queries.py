"""Evaluation metrics bound to the given tables (rows A1-A8, J1, J2, W1-W5, L4, L7-L8, L10, L12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodium import dims
from episodium.functions.keyed import keyed_int, sql_int
from episodium.operators import evaluation as ev
from episodium.operators import metric_state
from episodium.plans import bindings as b
from episodium.plans.registry import query
from episodium.workspace import new_folder

PERFORMANCE = f"""{b.EPISODES}, performance AS (
  SELECT partition, task, CAST(sum(is_successful_at_end::INT) AS BIGINT) AS num_successful,
    CAST(coalesce(sum(strict::INT), 0) AS BIGINT) AS num_successful_strict,
    count(time_limit) AS total_episodes
  FROM episodes GROUP BY partition, task),
shares AS (SELECT *, num_successful_strict / nullif(total_episodes, 0) AS percentage_successful_strict,
    num_successful / nullif(total_episodes, 0) AS percentage_successful FROM performance)"""


@query("a1_task_performance", f"WITH {PERFORMANCE} SELECT * FROM shares")
def a1(spark, folder):
    return b.episodes(spark, folder).transform(ev.task_performance)


@query(
    "a2_strict_success",
    f"WITH {b.EPISODES} SELECT idx, steps_taken, time_limit, is_successful_at_end, strict FROM episodes",
)
def a2(spark, folder):
    return b.episodes(spark, folder).select(
        "idx", "steps_taken", "time_limit", "is_successful_at_end", "strict"
    )


@query(
    "a3_macro_average",
    f"""WITH {PERFORMANCE} SELECT partition, round(avg(percentage_successful) * 100, 1) AS success,
      round(avg(percentage_successful_strict) * 100, 1) AS success_strict FROM shares GROUP BY partition""",
)
def a3(spark, folder):
    return b.episodes(spark, folder).transform(ev.task_performance).transform(ev.macro_average)


@query(
    "a4_report_average",
    f"""WITH {PERFORMANCE}, tenths AS (
      SELECT partition, round_even(percentage_successful_strict * 100, 1) AS p FROM shares)
    SELECT 'L' || partition AS level, count(*) AS tasks,
      CAST(round_even(avg(p), 1) AS DOUBLE) AS average FROM tenths GROUP BY partition""",
)
def a4(spark, folder):
    report = b.episodes(spark, folder).transform(ev.task_performance).transform(ev.report_average)
    return report.withColumn("average", F.col("average").cast("double"))


ONLINE = f"""WITH {b.EPISODES}, sums AS (
  SELECT partition, task, count(*) AS seen, sum(is_successful_at_end::INT) AS won, sum(steps_taken) AS steps
  FROM episodes GROUP BY partition, task),
keyed AS (SELECT *, printf('/L%d/Task%02d', partition, task + 1) AS k FROM sums)
SELECT 'seen' || k AS key, CAST(seen AS DOUBLE) AS value FROM keyed
UNION ALL SELECT 'steps' || k, steps / seen FROM keyed
UNION ALL SELECT 'success' || k, won / seen FROM keyed
UNION ALL SELECT 'total/seen', CAST(sum(seen) AS DOUBLE) FROM sums
UNION ALL SELECT 'total/success', sum(won) / sum(seen) FROM sums"""


@query("a5_online_metrics", ONLINE)
def a5(spark, folder):
    return b.episodes(spark, folder).transform(ev.online_metrics)


@query(
    "a6_step_histogram",
    f"""WITH {b.EPISODES}, counts AS (SELECT task, steps_taken, count(*) AS n FROM episodes GROUP BY ALL),
    bins AS (SELECT task, unnest(range(0, max(steps_taken) + 1)) AS steps_taken FROM counts GROUP BY task)
    SELECT task, steps_taken, coalesce(n, 0) AS n FROM bins LEFT JOIN counts USING (task, steps_taken)""",
)
def a6(spark, folder):
    return ev.value_histogram(b.outcomes(spark, folder), "task", "steps_taken")


@query(
    "a7_max_seed",
    f"""WITH {b.INSTANCES}, split AS (SELECT task, seed,
      CASE WHEN {sql_int(10, "split", "idx")} = 0 THEN 'valid' ELSE 'train' END AS split FROM instances)
    SELECT task, split, max(seed) AS max_seed FROM split GROUP BY ROLLUP (task, split)""",
)
def a7(spark, folder):
    split = F.when(keyed_int(10, "split", "idx") == 0, "valid").otherwise("train")
    return b.instances(spark, folder).withColumn("split", split).transform(ev.max_seeds)


@query(
    "a8_generation_summary",
    f"""WITH {b.OUTCOMES} SELECT task, count(*) AS episodes, min(steps_taken) AS min_steps,
      max(steps_taken) AS max_steps, sum(steps_taken) / count(*) AS mean_steps,
      min(seed) AS min_seed, max(seed) AS max_seed FROM outcomes GROUP BY task""",
)
def a8(spark, folder):
    return b.outcomes(spark, folder).transform(ev.generation_summary)


@query(
    "j1_joined_aggregates",
    f"""WITH {b.EPISODES}, won AS (
      SELECT partition, task, CAST(sum(is_successful_at_end::INT) AS BIGINT) AS num_successful FROM episodes GROUP BY ALL),
    seen AS (SELECT partition, task, count(time_limit) AS total_episodes FROM episodes GROUP BY ALL)
    SELECT * FROM won JOIN seen USING (partition, task)""",
)
def j1(spark, folder):
    return (
        b.episodes(spark, folder)
        .transform(ev.task_performance)
        .select("partition", "task", "num_successful", "total_episodes")
    )


# runs: the eight baselines, three variants of them, and one run that has no baseline
RUNS = [
    *[(run_id, name) for name, run_id in dims.BASELINE_RUNS.items()],
    ("variant1", "X+ObjShuf / Orig - ObjText"),
    ("variant2", "D+Ptch / Para - No Text"),
    ("variant3", "X+Ptch+14 / Orig w/Null - Para"),
    ("stranger", "Z+Obj / Given"),
]
RUN_OF_SEED = {i: run_id for i, (run_id, _) in enumerate(RUNS)}
RUN_VALUES = f"""{b.OUTCOMES}, run_values AS (
  SELECT {b.sql_lookup(RUN_OF_SEED, f"(seed % {len(RUNS)})")} AS run_id, 'L' || partition AS level, task,
    sum(is_successful_at_end::INT) / count(*) AS value
  FROM outcomes
  WHERE NOT (seed % {len(RUNS)} = 0 AND task = 2)
  GROUP BY ALL)"""


@query(
    "j2_baseline_delta",
    f"""WITH {RUN_VALUES}, {b.sql_values("runs", ["run_id", "run_name"], RUNS)},
    {b.sql_values("baselines", ["baseline_id", "baseline_name"], [(i, n) for n, i in dims.BASELINE_RUNS.items()])},
    named AS (SELECT r.*, l.baseline_id FROM runs r LEFT JOIN baselines l
      ON starts_with(r.run_name, split_part(l.baseline_name, ' / ', 1))
      AND contains(r.run_name, ' / ' || split_part(l.baseline_name, ' / ', 2)))
    SELECT v.run_id, v.level, v.task, v.value, v.value - o.value AS delta,
      CASE WHEN n.baseline_id IS NULL THEN 'no baseline' WHEN o.value IS NULL THEN 'missing task' ELSE 'ok' END AS status
    FROM run_values v JOIN named n USING (run_id)
    LEFT JOIN run_values o ON o.run_id = n.baseline_id AND o.level = v.level AND o.task = v.task""",
)
def j2(spark, folder):
    number = F.col("seed") % len(RUNS)
    values = (
        b.outcomes(spark, folder)
        .where(~((number == 0) & (F.col("task") == 2)))
        .groupBy(
            b.lookup(RUN_OF_SEED, number.cast("int")).alias("run_id"),
            ev.level_label(F.col("partition")).alias("level"),
            "task",
        )
        .agg((F.sum(F.col("is_successful_at_end").cast("int")) / F.count(F.lit(1))).alias("value"))
    )
    runs = spark.createDataFrame(RUNS, "run_id string, run_name string")
    return ev.baseline_delta(values, runs, dims.BASELINE_RUNS)


AFTER = f"""{b.STEPS}, firsts AS (SELECT idx, min(t) AS first_t FROM steps WHERE success GROUP BY idx),
after AS (SELECT s.idx, count(*) FILTER (t > first_t) AS n, count(*) FILTER (t > first_t AND NOT success) AS fails,
    any_value(first_t) AS first_t FROM steps s LEFT JOIN firsts USING (idx) GROUP BY s.idx)"""


@query(
    "w1_hesitance",
    f"""WITH {AFTER} SELECT idx, CASE WHEN first_t IS NULL THEN NULL WHEN n = 0 THEN 0.0e0 ELSE fails / n END AS hesitance
    FROM after""",
)
def w1(spark, folder):
    return b.steps(spark, folder).transform(ev.hesitance)


@query(
    "w2_flailing",
    f"""WITH {AFTER} SELECT idx, round(CASE WHEN first_t IS NULL THEN NULL WHEN n = 0 THEN 0.0e0 ELSE tanh(ln(n)) END, 9) AS flailing
    FROM after""",
)
def w2(spark, folder):
    return (
        b.steps(spark, folder)
        .transform(ev.flailing)
        .withColumn("flailing", F.round("flailing", 9))
    )


@query(
    "w3_final_success",
    f"""WITH {b.STEPS}, last AS (SELECT idx, success FROM steps
      QUALIFY row_number() OVER (PARTITION BY idx ORDER BY t DESC) = 1)
    SELECT o.o_orderkey AS idx, coalesce(success, false) AS final_success
    FROM orders o LEFT JOIN last ON last.idx = o.o_orderkey""",
)
def w3(spark, folder):
    headers = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("idx"))
    return ev.final_success(headers, b.steps(spark, folder))


MAX_STEPS = 6


@query(
    "w4_termination",
    f"""WITH {b.STEPS}, marked AS (SELECT *, CASE WHEN qty > 45 THEN 'pointless' WHEN qty < 4 THEN 'failed'
        WHEN success THEN 'success' END AS reason FROM steps WHERE t < {MAX_STEPS}),
    kept AS (SELECT *, coalesce(max(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (
        PARTITION BY idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM marked)
    SELECT idx, t, CASE reason WHEN 'pointless' THEN NULL WHEN 'failed' THEN false ELSE success END AS recorded
    FROM kept WHERE stopped = 0""",
)
def w4(spark, folder):
    taken = ev.terminate(
        b.steps(spark, folder), MAX_STEPS, pointless=F.col("qty") > 45, failed=F.col("qty") < 4
    )
    return taken.select("idx", "t", "recorded")


@query(
    "w5_time_limit_bonus",
    f"""WITH {b.STEPS}, limits AS (SELECT o_orderkey AS idx, o_custkey % 4 AS oracle_max_steps FROM orders)
    SELECT idx, count(*) AS steps_kept, max(t) AS last_t FROM steps JOIN limits USING (idx)
    WHERE t < oracle_max_steps + 2 GROUP BY idx""",
)
def w5(spark, folder):
    limits = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 4).alias("oracle_max_steps")
    )
    kept = ev.within_time_limit(b.steps(spark, folder), limits)
    return kept.groupBy("idx").agg(
        F.count(F.lit(1)).alias("steps_kept"), F.max("t").alias("last_t")
    )


REPEATS = 3


@query(
    "l4_repeated_episodes",
    f"""WITH {b.INSTANCES}, repeats AS (SELECT unnest(range(0, {REPEATS})) AS repeat)
    SELECT idx, partition, task, CAST(repeat AS INTEGER) AS repeat FROM instances, repeats""",
)
def l4(spark, folder):
    return ev.repeat_rows(b.instances(spark, folder).select("idx", "partition", "task"), REPEATS)


PAIRS = [(level, task) for level, tasks in dims.TASKS_PER_LEVEL.items() for task in tasks]


def evaluation_pairs(spark):
    """Every (partition, task) that is evaluated."""
    return spark.createDataFrame(PAIRS, "partition int, task int")


@query(
    "l7_evaluation_set",
    f"""WITH {b.INSTANCES}, {b.sql_values("pairs", ["partition", "task"], PAIRS)}
    SELECT p.partition, p.task, count(i.idx) AS episodes
    FROM pairs p LEFT JOIN instances i ON i.partition = p.partition AND i.task = p.task GROUP BY ALL""",
)
def l7(spark, folder):
    return ev.evaluation_set(evaluation_pairs(spark), b.instances(spark, folder))


# an episode with an even seed asks for level 4, which its task is not part of
_ASKED = "CASE WHEN seed % 2 = 0 THEN 4 ELSE partition END"


@query(
    "l8_availability",
    f"""WITH {b.INSTANCES}, {b.sql_values("pairs", ["partition", "task"], PAIRS)},
    asked AS (SELECT task, {_ASKED} AS partition FROM instances)
    SELECT a.task, count(*) FILTER (a.partition = 1) AS l1, count(*) FILTER (a.partition = 2) AS l2,
      count(*) FILTER (a.partition = 3) AS l3, count(*) FILTER (a.partition = 4) AS l4,
      count(*) FILTER (p.task IS NULL) AS invalid
    FROM asked a LEFT JOIN pairs p ON p.partition = a.partition AND p.task = a.task GROUP BY a.task""",
)
def l8(spark, folder):
    asked = b.instances(spark, folder).select("task", F.expr(_ASKED).alias("partition"))
    return ev.availability(asked, evaluation_pairs(spark), [1, 2, 3, 4])


# task position: where the task stands among the five tasks in use
POSITIONS = {task: i for i, task in enumerate(sorted(dims.TASK_IDS_BY_ANY_NAME[n] for n in b.TASK_NAME_OF_PRIORITY.values()))}
WORKERS = 7
DEFINITIONS = f"""{b.INSTANCES}, definitions AS (
  SELECT idx AS episode, {b.sql_lookup(POSITIONS, "task")} AS position FROM instances)"""


def definitions(spark, folder):
    return b.instances(spark, folder).select(
        F.col("idx").alias("episode"), b.lookup(POSITIONS, F.col("task")).alias("position")
    )


@query(
    "l10_seed_schedule",
    f"""WITH {DEFINITIONS}, schedule AS (SELECT *, (1000 + episode) * (position + 1) * 999 AS seed FROM definitions)
    SELECT episode, position, seed, count(*) OVER (PARTITION BY seed) AS episodes_with_seed FROM schedule""",
)
def l10(spark, folder):
    return ev.seed_schedule(definitions(spark, folder), 1000)


@query(
    "l10_worker_chunks",
    f"""WITH {DEFINITIONS}, n AS (SELECT *, row_number() OVER (ORDER BY position, episode) - 1 AS i, count(*) OVER () AS total FROM definitions)
    SELECT episode, position, i // CAST(ceil(total / {WORKERS}) AS BIGINT) AS chunk FROM n""",
)
def l10_chunks(spark, folder):
    return ev.worker_chunks(definitions(spark, folder), WORKERS)


@query(
    "l12_first_success",
    """SELECT l_orderkey AS idx, min(l_partkey) AS seed, count(*) AS successes
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
)
def l12(spark, folder):
    attempts = b.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("idx"),
        F.col("l_partkey").alias("seed"),
        (F.col("l_returnflag") == "R").alias("success"),
    )
    return ev.first_successful_attempt(attempts, ["idx"])


@query("u3_merged_metrics", ONLINE)
def u3(spark, folder):
    episodes = b.outcomes(spark, folder).select("idx", "partition", "task", "is_successful_at_end", "steps_taken")
    state = metric_state.online_state(spark, new_folder(spark, "metric-state"))
    state.update(episodes, "all")
    state.reset()
    for part in (0, 1, 2, 1):  # the second batch is replayed
        state.update(episodes.where(F.col("idx") % 3 == part), f"part-{part}")
    return metric_state.online_rows(state)
