"""Streaming twins bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodium.plans import bindings as b
from episodium.plans.evaluation_queries import MAX_STEPS, ONLINE
from episodium.plans.registry import query
from episodium.streaming import jobs
from episodium.workspace import new_folder

EPISODE_SCHEMA = "partition int, task int, is_successful_at_end boolean, steps_taken bigint"


@query("x1_running_metrics", ONLINE)
def x1(spark, folder):
    source, target, checkpoint = (new_folder(spark, p) for p in ("episodes", "metrics", "checkpoint"))
    episodes = b.outcomes(spark, folder).select("partition", "task", "is_successful_at_end", "steps_taken")
    # several files, so that the stream runs in several batches
    episodes.repartition(4).write.parquet(source)
    stream = jobs.file_stream(spark, source, EPISODE_SCHEMA, files=2)
    jobs.publish_metrics(stream, target, checkpoint).awaitTermination()
    return jobs.latest_metrics(spark, target)


EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query(
    "x1_running_event_metrics",
    """WITH e AS (SELECT CAST(user_id % 4 + 1 AS INTEGER) AS partition, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS task,
      value > 10 AS won, CAST(json_extract(props, '$.k') AS BIGINT) AS steps FROM events),
    sums AS (SELECT partition, task, count(*) AS seen, sum(won::INT) AS won, sum(steps) AS steps FROM e GROUP BY ALL),
    keyed AS (SELECT *, printf('/L%d/Task%02d', partition, task + 1) AS k FROM sums)
    SELECT 'seen' || k AS key, CAST(seen AS DOUBLE) AS value FROM keyed UNION ALL SELECT 'steps' || k, steps / seen FROM keyed
    UNION ALL SELECT 'success' || k, won / seen FROM keyed
    UNION ALL SELECT 'total/seen', CAST(sum(seen) AS DOUBLE) FROM sums UNION ALL SELECT 'total/success', sum(won) / sum(seen) FROM sums""",
)
def x1_events(spark, folder):
    target, checkpoint = new_folder(spark, "metrics"), new_folder(spark, "checkpoint")
    tasks = {"signup": 0, "purchase": 1, "error": 2, "view": 3, "click": 4}
    events = jobs.file_stream(spark, folder, EVENT_SCHEMA, "events.parquet").select(
        (F.col("user_id") % 4 + 1).cast("int").alias("partition"),
        b.lookup(tasks, F.col("event_type")).alias("task"),
        (F.col("value") > 10).alias("is_successful_at_end"),
        F.from_json("props", "k bigint")["k"].alias("steps_taken"),
    )
    jobs.publish_metrics(events, target, checkpoint).awaitTermination()
    return jobs.latest_metrics(spark, target)


def step_log(spark, folder):
    """Steps as an environment would log them: stop reason and end mark included."""
    steps = b.steps(spark, folder)
    ends = steps.groupBy("idx").agg(F.max("t").alias("last_t"))
    reason = (
        F.when(F.col("qty") > 45, "pointless").when(F.col("qty") < 4, "failed").when(F.col("success"), "success")
    )
    return steps.join(ends, "idx").select(
        "idx", "t", "success", reason.alias("reason"), (F.col("t") == F.col("last_t")).alias("is_last"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived"),
    )


@query(
    "x2_episode_buffer",
    f"""WITH {b.STEPS}, marked AS (SELECT *, CASE WHEN qty > 45 THEN 'pointless' WHEN qty < 4 THEN 'failed' WHEN success THEN 'success' END AS reason,
      max(t) OVER (PARTITION BY idx) AS last_t FROM steps),
    stops AS (SELECT idx, min(t) AS stop_t FROM marked WHERE reason IS NOT NULL OR t = last_t OR t = {MAX_STEPS - 1} GROUP BY idx),
    kept AS (SELECT m.*, stop_t FROM marked m JOIN stops USING (idx) WHERE t <= stop_t)
    SELECT idx, count(*) AS steps_taken,
      coalesce(string_agg(CASE WHEN success AND coalesce(reason, '') <> 'failed' THEN '1' ELSE '0' END, '' ORDER BY t) FILTER (coalesce(reason, '') <> 'pointless'), '') AS recorded,
      coalesce(arg_max(success AND coalesce(reason, '') <> 'failed', t) FILTER (coalesce(reason, '') <> 'pointless'), false) AS final_success,
      coalesce(max(reason) FILTER (t = stop_t), CASE WHEN any_value(stop_t = last_t) THEN 'end' ELSE 'limit' END) AS reason
    FROM kept GROUP BY idx""",
)
def x2(spark, folder):
    source, target, checkpoint = (new_folder(spark, p) for p in ("steps", "closed", "checkpoint"))
    # files are cut across episodes, so steps of one episode arrive in different batches
    step_log(spark, folder).repartition(4, "t", "idx").write.parquet(source)
    stream = jobs.file_stream(spark, source, jobs.STEP_SCHEMA, files=2)
    ended = jobs.buffer_episodes(stream, MAX_STEPS)
    jobs.start_buffer(ended, target, checkpoint).awaitTermination()
    return spark.read.schema(jobs.CLOSED_SCHEMA).parquet(target)


@query(
    "x3_episode_log",
    f"""WITH {b.EPISODES} SELECT partition, count(*) AS n, count(time_limit) AS n_limits, CAST(sum(steps_taken) AS BIGINT) AS steps
    FROM (SELECT partition, steps_taken, CASE WHEN partition = 2 THEN time_limit END AS time_limit FROM episodes) GROUP BY partition""",
)
def x3(spark, folder):
    episodes = b.episodes(spark, folder).select("idx", "partition", "task", "steps_taken", "time_limit")
    log = new_folder(spark, "log")
    paths = []
    # one writer does not know time limits yet
    for name, rows in {
        "early": episodes.where("partition <> 2").drop("time_limit"),
        "late": episodes.where("partition = 2"),
    }.items():
        source = new_folder(spark, "episodes")
        rows.repartition(2).write.parquet(source)
        stream = jobs.file_stream(spark, source, rows.schema.simpleString()[7:-1].replace(":", " "))
        paths.append(f"{log}/{name}")
        jobs.log_stream(stream, paths[-1], new_folder(spark, "checkpoint")).awaitTermination()
    return jobs.read_log(spark, *paths).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.count("time_limit").alias("n_limits"), F.sum("steps_taken").alias("steps")
    )
