"""Closing rules of the episode buffer, its timers and restarts, and repeated deliveries."""

from pyspark.sql import functions as F

from episodium.streaming import jobs


def close(steps, max_steps=5):
    """Outcome of an episode as a dict, None while it waits, from {t: (success, reason, is_last)}."""
    leading = jobs.leading_steps([(t, *values) for t, values in steps.items()])
    end = jobs.end_of(leading, max_steps)
    if end is None:
        return None
    found = jobs.outcome(1, leading[: end[0]], end[1]).asDict()
    return {k: v for k, v in found.items() if k != "idx"}


def test_close_waits_for_earlier_steps():
    late = {1: (True, "success", False)}
    assert close(late) is None
    done = {"steps_taken": 2, "recorded": "01", "final_success": True, "reason": "success"}
    assert close({**late, 0: (False, None, False), 3: (True, None, True)}) == done


def test_pointless_step_is_not_recorded():
    done = {"steps_taken": 1, "recorded": "", "final_success": False, "reason": "pointless"}
    assert close({0: (False, "pointless", False)}) == done


def test_failed_step_never_succeeds():
    assert close({0: (True, "failed", False)})["recorded"] == "0"


def test_limit_and_end():
    steps = {t: (False, None, t == 2) for t in range(3)}
    assert close(steps, 3)["reason"] == "end"
    assert close({t: steps[t] for t in (0, 1)}, 2)["reason"] == "limit"


def test_no_steps():
    assert close({}) is None


def test_buffer_times_out_restarts_and_drops_late_steps(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    deliveries = {
        "00:00": [(1, 0, False, None, False), (1, 1, True, "success", False), (2, 0, True, None, False),
                  (2, 2, False, None, False), (3, 0, False, None, False), (6, 0, True, None, False), (6, 1, True, None, False)],
        # a late step and a repeated one for closed and waiting episodes, and an episode of one step
        "00:10": [(1, 2, False, None, False), (1, 0, False, None, False), (2, 2, False, None, False),
                  (4, 0, False, None, True), (6, 2, False, None, False), (6, 3, False, None, False), (6, 4, True, None, False)],
        # long after, everything that waits has timed out
        "05:00": [(5, 0, True, "success", False), (6, 5, True, None, False)],
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    seen = []
    try:
        for cores, (clock, rows) in zip((8, 3, 5), deliveries.items()):
            spark.conf.set("spark.sql.shuffle.partitions", cores)  # a restart elsewhere
            frame = spark.createDataFrame(rows, "idx bigint, t bigint, success boolean, reason string, is_last boolean")
            at = F.lit(f"2024-01-01 {clock}:00").cast("timestamp")
            frame.withColumn("arrived", at).coalesce(1).write.mode("append").parquet(source)
            stream = jobs.file_stream(spark, source, jobs.STEP_SCHEMA)
            jobs.start_buffer(jobs.buffer_episodes(stream, 4), target, checkpoint).awaitTermination(120)
            seen.append({tuple(r) for r in spark.read.schema(jobs.CLOSED_SCHEMA).parquet(target).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    assert seen[0] == {(1, 2, "01", True, "success")}
    # the endless episode ends at the limit
    assert seen[1] - seen[0] == {(4, 1, "0", False, "end"), (6, 4, "1100", False, "limit")}
    late = {(5, 1, "1", True, "success"), (2, 1, "1", True, "timeout"), (3, 1, "0", False, "timeout")}
    assert seen[2] - seen[1] == late


def test_repeated_deliveries_count_once(spark, tmp_path):
    rows = spark.range(20).select(
        (F.col("id") % 5).alias("idx"), (F.col("id") % 2).alias("t"), F.lit("2024-01-01").cast("timestamp").alias("arrived")
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "idx bigint, t bigint, arrived timestamp")
    once = jobs.deduplicated(stream, "arrived", ["idx", "t"], "1 hour")
    jobs.log_stream(once, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(60)
    assert jobs.read_log(spark, str(tmp_path / "log")).count() == 10


def test_steps_of_a_third_batch_count_and_a_retried_batch_changes_nothing(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    kind = "idx bigint, t bigint, success boolean, reason string, is_last boolean"
    batches = [
        [(1, 0, False, None, False), (2, 1, True, None, True), (3, 0, False, None, False)],
        [(1, 1, False, None, False), (1, 1, False, None, False), (2, 0, True, None, False)],
        [(1, 2, True, "success", False), (2, 0, False, None, True), (4, 0, False, "failed", False)],
    ]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for rows in batches:
        frame = spark.createDataFrame(rows, kind).withColumn("arrived", at)
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = jobs.file_stream(spark, source, jobs.STEP_SCHEMA)
    jobs.start_buffer(jobs.buffer_episodes(stream, 4), target, checkpoint).awaitTermination(120)
    ended = {(1, 3, "001", True, "success"), (2, 2, "11", True, "end"), (4, 1, "0", False, "failed")}

    def found():
        rows = [tuple(r) for r in spark.read.schema(jobs.CLOSED_SCHEMA).parquet(target).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    assert found() == ended
    # the last batch once more, as after a failure; then time passes
    again = spark.createDataFrame(batches[2], kind).withColumn("arrived", at)
    buffer = jobs.EpisodeBuffer(4, 3_600_000, target, checkpoint)
    buffer(again, 2)
    assert found() == ended
    later = spark.createDataFrame([(5, 0, True, "success", False)], kind)
    buffer(later.withColumn("arrived", F.lit("2024-01-01 02:00:00").cast("timestamp")), 3)
    assert found() - ended == {(5, 1, "1", True, "success"), (3, 1, "0", False, "timeout")}
    assert not spark.read.parquet(f"{checkpoint}/episodes/3").where("idx = 1").count()
