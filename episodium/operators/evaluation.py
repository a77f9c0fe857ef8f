"""Evaluation metrics over episodes and their steps.

Step-level metrics use the step index ``t`` and plain aggregates, so that partial aggregation runs
before the shuffle and no episode has to fit into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodium import dims
from episodium.functions.pose import all_close
from episodium.functions.ranking import sliced_index

SWEEPS = [dims.TASKS["sweep_without_exceeding"], dims.TASKS["sweep_without_touching"]]
IN_ORDER = dims.TASKS["pick_in_order_then_restore"]
BIN_BLOCK = 65_536
ONE_MOVE = [dims.TASKS["novel_adj"], dims.TASKS["novel_adj_and_noun"]]


def with_time_limit(episodes: DataFrame) -> DataFrame:
    """Steps an episode may take, by the rule of its task."""
    task = F.col("task")
    limit = (
        F.when(task.isin(SWEEPS), F.col("max_swept_obj"))
        .when(task == IN_ORDER, F.col("num_target_base_obj"))
        .when(task.isin(ONE_MOVE), F.lit(1))
        .otherwise(F.col("num_dragged_obj"))
    )
    return episodes.withColumn("time_limit", limit.cast("bigint"))


def with_strict_success(episodes: DataFrame) -> DataFrame:
    """Success within the time limit; a success without a limit stays unknown."""
    strict = F.when(
        F.col("is_successful_at_end"), F.col("time_limit") - F.col("steps_taken") >= 0
    ).otherwise(F.lit(False))
    return episodes.withColumn("strict", strict)


def task_performance(episodes: DataFrame) -> DataFrame:
    """Successes and success shares per (partition, task); the total counts episodes with a limit."""
    done = F.sum(F.col("is_successful_at_end").cast("int"))
    strict = F.sum(F.col("strict").cast("int"))
    return (
        episodes.groupBy("partition", "task")
        .agg(
            done.alias("num_successful"),
            F.coalesce(strict, F.lit(0)).alias("num_successful_strict"),
            F.count("time_limit").alias("total_episodes"),
        )
        .select(
            "partition",
            "task",
            "num_successful",
            "num_successful_strict",
            "total_episodes",
            F.try_divide("num_successful_strict", "total_episodes").alias(
                "percentage_successful_strict"
            ),
            F.try_divide("num_successful", "total_episodes").alias("percentage_successful"),
        )
    )


def level_label(partition: Column) -> Column:
    """``L1`` for partition 1."""
    return F.concat(F.lit("L"), partition.cast("string"))


def macro_average(performance: DataFrame) -> DataFrame:
    """Mean over tasks of the unrounded shares, in percent, one decimal."""
    return performance.groupBy("partition").agg(
        F.round(F.avg("percentage_successful") * 100, 1).alias("success"),
        F.round(F.avg("percentage_successful_strict") * 100, 1).alias("success_strict"),
    )


def rounded_percent(share: Column) -> Column:
    """Share in percent with one decimal; halves go to the even digit."""
    return F.bround((share * 100).cast("decimal(20,12)"), 1).cast("decimal(6,1)")


def report_average(performance: DataFrame, share: str = "percentage_successful_strict") -> DataFrame:
    """Mean per level of the already rounded task values, rounded again to the even digit."""
    return (
        performance.where(F.col(share).isNotNull())
        .select(level_label(F.col("partition")).alias("level"), rounded_percent(F.col(share)).alias("p"))
        .groupBy("level")
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.bround(F.avg(F.col("p").cast("decimal(20,10)")), 1).cast("decimal(6,1)").alias("average"),
        )
    )


def metric_key(metric: str, partition: Column, task: Column) -> Column:
    """``success/L1/Task01``."""
    return F.format_string(f"{metric}/L%d/Task%02d", partition, task + 1)


def online_metrics(episodes: DataFrame) -> DataFrame:
    """Running totals as (key, value): success, steps and seen per task, and the overall rate."""
    sums = episodes.groupingSets(
        [["partition", "task"], []], "partition", "task"
    ).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("seen"),
        F.sum(F.col("is_successful_at_end").cast("int")).alias("won"),
        F.sum("steps_taken").alias("steps"),
    )
    return metric_rows(sums.where(F.col("seen") > 0))


def metric_rows(sums: DataFrame) -> DataFrame:
    """Metric rows from sums per (partition, task); ``level`` > 0 marks the grand total."""
    total = F.col("level") > 0
    key = lambda name: metric_key(name, F.col("partition"), F.col("task"))
    entries = F.when(
        total,
        F.array(
            F.struct(F.lit("total/seen").alias("key"), F.col("seen").cast("double").alias("value")),
            F.struct(F.lit("total/success").alias("key"), (F.col("won") / F.col("seen")).alias("value")),
        ),
    ).otherwise(
        F.array(
            F.struct(key("seen").alias("key"), F.col("seen").cast("double").alias("value")),
            F.struct(key("steps").alias("key"), (F.col("steps") / F.col("seen")).alias("value")),
            F.struct(key("success").alias("key"), (F.col("won") / F.col("seen")).alias("value")),
        )
    )
    return sums.select(F.explode(entries).alias("m")).select("m.key", "m.value")


def after_success(steps: DataFrame) -> DataFrame:
    """Per episode: first success, steps after it, and how many of those are not successful.

    With a dense step index, the failures after the first success follow from three counts.
    """
    return (
        steps.groupBy("idx")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("success").cast("int")).alias("wins"),
            F.min(F.when(F.col("success"), F.col("t"))).alias("first_success"),
        )
        .withColumn("after", F.col("n") - 1 - F.col("first_success"))
        .withColumn("fails_after", F.col("after") - (F.col("wins") - 1))
    )


def hesitance(steps: DataFrame) -> DataFrame:
    """Share of failures after the first success; 0 if nothing follows, NULL if never successful."""
    return after_success(steps).select(
        "idx",
        F.when(F.col("after") == 0, F.lit(0.0))
        .otherwise(F.try_divide("fails_after", "after"))
        .alias("hesitance"),
    )


def flailing(steps: DataFrame) -> DataFrame:
    """tanh(ln n) of the n steps after the first success; 0 for none, NULL if never successful."""
    after = F.col("after")
    return after_success(steps).select(
        "idx", F.when(after == 0, F.lit(0.0)).otherwise(F.tanh(F.ln(after))).alias("flailing")
    )


def final_success(headers: DataFrame, steps: DataFrame) -> DataFrame:
    """Success of the last step; an episode without steps is not successful."""
    last = steps.groupBy("idx").agg(F.max_by("success", "t").alias("last"))
    return headers.join(last, "idx", "left").select(
        "idx", F.coalesce("last", F.lit(False)).alias("final_success")
    )


def first_stop(
    steps: DataFrame, pointless: Column, failed: Column, stop_on_success: bool = True
) -> DataFrame:
    """Per episode, when and why it ends.

    A pointless action ends it before the step counts for success; a failed move counts as a
    failed step; a success ends it after the step.
    """
    reason = (
        F.when(pointless, F.lit("pointless"))
        .when(failed, F.lit("failed"))
        .when(F.col("success") & F.lit(stop_on_success), F.lit("success"))
    )
    return (
        steps.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .groupBy("idx")
        .agg(F.min("t").alias("stop_t"), F.min_by("reason", "t").alias("reason"))
    )


def terminate(
    steps: DataFrame,
    max_steps: int,
    pointless: Column,
    failed: Column,
    stop_on_success: bool = True,
) -> DataFrame:
    """Steps that are really taken, with the success that gets recorded for each.

    The recorded success is NULL for the pointless action: it is part of the episode, yet the
    success tracker never sees it.
    """
    within = steps.where(F.col("t") < max_steps)
    stops = first_stop(within, pointless, failed, stop_on_success)
    return (
        within.join(stops, "idx", "left")
        .where(F.col("stop_t").isNull() | (F.col("t") <= F.col("stop_t")))
        .withColumn(
            "recorded",
            F.when(
                (F.col("t") == F.col("stop_t")) & (F.col("reason") == "pointless"),
                F.lit(None).cast("boolean"),
            )
            .when((F.col("t") == F.col("stop_t")) & (F.col("reason") == "failed"), F.lit(False))
            .otherwise(F.col("success")),
        )
    )


def is_pointless(position0: list[Column], rotation0: list[Column], position1: list[Column], rotation1: list[Column]) -> Column:
    """Both poses equal the starting pose: the agent has nothing left to do."""
    return (
        all_close(position0, dims.START_POSITION_2D)
        & all_close(rotation0, dims.START_ROTATION)
        & all_close(position1, dims.START_POSITION_2D)
        & all_close(rotation1, dims.START_ROTATION)
    )


def within_time_limit(steps: DataFrame, limits: DataFrame) -> DataFrame:
    """Steps up to the oracle's limit and two bonus steps."""
    return steps.join(limits, "idx").where(
        F.col("t") < F.col("oracle_max_steps") + dims.ORACLE_BONUS_STEPS
    )


def value_histogram(values: DataFrame, group: str, value: str) -> DataFrame:
    """Counts of an integer value per group, with empty bins from 0 to the group's maximum."""
    counts = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy(group).agg(F.max(value).cast("bigint").alias("top"))
    # a long row of bins is made in blocks, by several tasks
    first = F.col("block") * BIN_BLOCK
    blocks = tops.select(
        group, "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("top") / BIN_BLOCK))).alias("block")
    ).repartition(group, "block")
    bins = blocks.select(
        group, F.explode(F.sequence(first, F.least(F.col("top"), first + BIN_BLOCK - 1))).alias(value)
    )
    return bins.join(counts, [group, value], "left").select(
        group, value, F.coalesce("n", F.lit(0)).alias("n")
    )


def repeat_rows(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered."""
    numbers = F.sequence(F.lit(0), F.lit(times - 1))
    return rows.select("*", F.explode(numbers).alias("repeat"))


def first_successful_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest successful attempt per key; keys that never succeed are left out."""
    return (
        attempts.where(F.col("success"))
        .groupBy(*keys)
        .agg(F.min("seed").alias("seed"), F.count(F.lit(1)).alias("successes"))
    )


def episode_definitions(tasks: DataFrame, episodes_per_task: int) -> DataFrame:
    """One row per task and episode to generate."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(episodes_per_task - 1).cast("bigint"))
    return tasks.select("*", F.explode(numbers).alias("episode"))


def seed_schedule(definitions: DataFrame, start: int) -> DataFrame:
    """Starting seeds ``(start + episode) * (task position + 1) * 999``.

    The formula gives the same seed to episodes of different tasks; ``episodes_with_seed`` shows it.
    """
    scheduled = definitions.withColumn(
        "seed",
        (F.lit(start).cast("bigint") + F.col("episode"))
        * (F.col("position") + 1)
        * F.lit(dims.SEED_SPACING),
    )
    repeats = scheduled.groupBy("seed").agg(F.count(F.lit(1)).alias("episodes_with_seed"))
    return scheduled.join(repeats, "seed")


def worker_chunks(definitions: DataFrame, workers: int) -> DataFrame:
    """Consecutive chunks of ``ceil(n / workers)`` definitions, in order of task and episode."""
    inside = sliced_index(
        definitions,
        ["position"],
        [F.col("episode")],
        [F.floor(F.col("episode") / (1 << 14))],
        "__in_task",
    )
    sizes = definitions.groupBy("position").agg(F.count(F.lit(1)).alias("__n"))
    # one row per task: the window below is as small as the task table
    before = W.orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("position", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    size = definitions.agg(F.ceil(F.count(F.lit(1)) / workers)).scalar()
    return inside.join(starts, "position").select(
        *definitions.columns,
        F.floor((F.col("__start") + F.col("__in_task")) / size).alias("chunk"),
    )


def baseline_of(run_name: Column, baselines: dict[str, str]) -> Column:
    """Id of the first baseline whose name has the run's model in front and its data behind the slash."""
    choices = []
    for name, run_id in baselines.items():
        model, data = name.split(" / ")
        same = F.startswith(run_name, F.lit(model)) & F.contains(run_name, F.lit(f" / {data}"))
        choices.append(F.when(same, F.lit(run_id)))
    return F.coalesce(*choices)


def baseline_delta(values: DataFrame, runs: DataFrame, baselines: dict[str, str]) -> DataFrame:
    """Difference of a run's value to its baseline's, per (level, task).

    Runs without a baseline and tasks the baseline lacks are reported, not dropped.
    """
    named = runs.withColumn("baseline_id", baseline_of(F.col("run_name"), baselines))
    own = values.join(named, "run_id")
    reference = values.select(
        F.col("run_id").alias("baseline_id"),
        "level",
        "task",
        F.col("value").alias("baseline_value"),
    )
    joined = own.join(reference, ["baseline_id", "level", "task"], "left")
    return joined.select(
        "run_id",
        "level",
        "task",
        "value",
        (F.col("value") - F.col("baseline_value")).alias("delta"),
        F.when(F.col("baseline_id").isNull(), F.lit("no baseline"))
        .when(F.col("baseline_value").isNull(), F.lit("missing task"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )


# --- summaries and evaluation sets ------------------------------------------------------------------------


def max_seeds(rows: DataFrame) -> DataFrame:
    """Largest seed per (task, split), per task, and of all rows."""
    return rows.rollup("task", "split").agg(F.max("seed").alias("max_seed"))


def generation_summary(episodes: DataFrame) -> DataFrame:
    """Per task the number of episodes, their steps and seeds."""
    return episodes.groupBy("task").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.min("steps_taken").alias("min_steps"),
        F.max("steps_taken").alias("max_steps"),
        (F.sum("steps_taken") / F.count(F.lit(1))).alias("mean_steps"),
        F.min("seed").alias("min_seed"),
        F.max("seed").alias("max_seed"),
    )


def evaluation_set(pairs: DataFrame, instances: DataFrame) -> DataFrame:
    """Every (partition, task) of the specification with its number of episodes, 0 included."""
    counts = instances.groupBy("partition", "task").agg(F.count("idx").alias("episodes"))
    return pairs.join(counts, ["partition", "task"], "left").select(
        "partition", "task", F.coalesce("episodes", F.lit(0)).alias("episodes")
    )


def availability(asked: DataFrame, pairs: DataFrame, levels: list[int]) -> DataFrame:
    """Per task the number of rows that ask for each level, and of those whose pair is not in ``pairs``."""
    counts = asked.groupBy("task", "partition").agg(F.count(F.lit(1)).alias("n"))
    checked = counts.join(pairs.withColumn("valid", F.lit(True)), ["partition", "task"], "left")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return checked.groupBy("task").agg(
        *[total(F.col("partition") == level).alias(f"l{level}") for level in levels],
        total(F.col("valid").isNull()).alias("invalid"),
    )
