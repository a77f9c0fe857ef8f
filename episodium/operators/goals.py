"""Goals of an episode: matching, progress, order and outcome."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium import dims
from episodium.functions import pose as P
from episodium.functions.joins import large
from episodium.functions.ranking import running_index
from episodium.operators.scene import allowed_matches, pose_matches


def matched_pairs(objects: DataFrame, targets: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(idx, t, k) of objects and targets whose poses match; of the ``allowed`` pairs (idx, t, k) only."""
    if allowed is not None:
        return allowed_matches(objects, targets, allowed)
    return pose_matches(objects, targets, ["idx"]).select("idx", "t", F.col("target_k").alias("k"))


def assign_in_order(pairs: DataFrame) -> DataFrame:
    """At most one target for each object and one object for each target, from pairs (idx, t, k).

    Objects choose in order of ``t``, each the first target, in order of ``k``, that is still free.
    An episode's pairs are walked once, in that order; what is held is its taken targets.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        episode, chooser, taken = None, None, set()
        for batch in batches:
            kept = []
            for row, (idx, t, k) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if idx != episode:
                    episode, chooser, taken = idx, None, set()
                if t != chooser and k not in taken:
                    chooser = t
                    taken.add(k)
                    kept.append(row)
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = pairs.select("idx", "t", "k").distinct().repartition("idx").sortWithinPartitions("idx", "t", "k")
    return ordered.mapInArrow(walk, ordered.schema)


def nearest_open_target(objects: DataFrame, targets: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Nearest free target of each object that still has to move, farthest objects first.

    A target is taken by the first object (by ``t``) that matches it.  Objects that took a target
    stay, and objects without a free target are left out.  Objects carry idx, t and a pose; targets
    idx, k and a pose.  With ``allowed`` pairs (idx, t, k) an object matches, and may move to, these
    targets only.
    """
    pairs = matched_pairs(objects, targets, allowed)
    takers = pairs.groupBy("idx", "k").agg(F.min("t").alias("t"))
    waiting = objects.join(large(takers.select("idx", "t").distinct()), ["idx", "t"], "left_anti")
    free = targets.join(large(takers.select("idx", "k")), ["idx", "k"], "left_anti").select(
        "idx", "k", F.col("x").alias("tx"), F.col("y").alias("ty")
    )
    if allowed is None:
        # an episode's free targets meet each object as one list, so no pairs are sorted
        lists = free.groupBy("idx").agg(F.collect_list(F.struct("k", "tx", "ty")).alias("free"))
        away = lambda f: P.distance((F.col("x"), f["tx"]), (F.col("y"), f["ty"]))
        reach = F.transform("free", lambda f: F.struct(away(f).alias("d"), f["k"].alias("k")))
        best = waiting.select("idx", "t", "x", "y").join(large(lists), "idx").select("idx", "t", F.array_min(reach).alias("best"))
    else:
        possible = allowed.select("idx", "t", "k").join(large(waiting), ["idx", "t"]).join(large(free), ["idx", "k"])
        away = P.distance((F.col("x"), F.col("tx")), (F.col("y"), F.col("ty")))
        best = possible.groupBy("idx", "t").agg(F.min(F.struct(away.alias("d"), "k")).alias("best"))
    nearest = best.select("idx", "t", F.col("best.k").alias("k"), F.col("best.d").alias("distance"))
    return running_index(nearest, ["idx"], [-F.col("distance"), F.col("t")], "rank")


def distractor_conflicts(distractors: DataFrame, targets: DataFrame, objects: DataFrame) -> DataFrame:
    """Episodes in which a distractor stands on a target or an object stands where a distractor is."""
    on_target = pose_matches(distractors, targets, ["idx"], "left_semi").select("idx")
    on_distractor = pose_matches(objects, distractors, ["idx"], "left_semi", crowded=True).select("idx")
    return on_target.union(on_distractor).distinct()


def pose_progress(
    objects: DataFrame,
    targets: DataFrame,
    max_progress: float = 1.0,
    allowed: DataFrame | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Share of an episode's objects that match a target, and whether that completes the goal.

    With ``allowed`` pairs (idx, t, k) an object counts for these targets only.  Objects on the same
    target count each, unless the goal is ``exclusive``: then a target counts once, for the first
    object on it, see :func:`assign_in_order`.
    """
    if allowed is None and not exclusive:
        on_target = pose_matches(objects, targets, ["idx"], "left_semi")
    else:
        pairs = matched_pairs(objects, targets, allowed)
        on_target = assign_in_order(pairs) if exclusive else pairs.select("idx", "t").distinct()
    done = on_target.groupBy("idx").agg(F.count(F.lit(1)).alias("done"))
    total = objects.groupBy("idx").agg(F.count(F.lit(1)).alias("objects"))
    progress = F.lit(max_progress) * F.coalesce("done", F.lit(0)) / F.col("objects")
    return total.join(large(done), "idx", "left").select(
        "idx",
        progress.alias("progress"),
        (F.abs(F.lit(max_progress) - progress) < dims.PROGRESS_TOLERANCE).alias("complete"),
    )


def zone_progress(points: DataFrame, zones: DataFrame, top: float, max_progress: float = 1.0) -> DataFrame:
    """Share of points inside the oriented zones of their episode.

    Zones carry idx, their place zx, zy, zz, turn (cosine and sine as c, s) and sizes w, h; a point
    is moved into the zone's own frame, also in height.  Every point counts once per zone.
    """
    dx, dy = F.col("x") - F.col("zx"), F.col("y") - F.col("zy")
    u = F.col("c") * dx + F.col("s") * dy
    v = F.col("c") * dy - F.col("s") * dx
    inside = (
        (u > -F.col("w") / 2) & (u < F.col("w") / 2)
        & (v > -F.col("h") / 2) & (v < F.col("h") / 2)
        & (F.col("z") - F.col("zz") < top)
    )
    share = F.lit(max_progress) * (F.count_if(inside) / F.count(F.lit(1)))
    return (
        points.join(large(zones), "idx")
        .groupBy("idx")
        .agg(share.alias("progress"))
        .withColumn("complete", F.abs(F.lit(max_progress) - F.col("progress")) < dims.PROGRESS_TOLERANCE)
    )


def rearrangement_outcome(headers: DataFrame, goals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Success, failure and distance per episode.

    Goals carry idx, done, oracle_only, the object's x, y and its base_x, base_y.  With nothing left
    to do, a distractor conflict turns success into failure; otherwise an object off the table is a
    failure and the distance is the mean over what is left.
    """
    left = ~F.col("done") & ~F.col("oracle_only")
    away = P.distance((F.col("x"), F.col("base_x")), (F.col("y"), F.col("base_y")))
    remaining = goals.groupBy("idx").agg(
        F.count_if(left).alias("left"),
        F.bool_or(F.when(left, ~P.in_workspace(F.col("x"), F.col("y")))).alias("off_table"),
        F.avg(F.when(left, away)).alias("away"),
    )
    clash = conflicts.select("idx").withColumn("clash", F.lit(True))
    finished = F.coalesce("left", F.lit(0)) == 0
    clashes = F.coalesce("clash", F.lit(False))
    return (
        headers.join(large(remaining), "idx", "left")
        .join(large(clash), "idx", "left")
        .select(
            "idx",
            (finished & ~clashes).alias("success"),
            F.when(finished, clashes).otherwise(F.coalesce("off_table", F.lit(False))).alias("failure"),
            F.when(finished, F.lit(dims.POSITION_TOLERANCE)).otherwise(F.col("away")).alias("distance"),
        )
    )


def constraint_outcome(objects: DataFrame, target: Column) -> DataFrame:
    """Outcome of a counting task.

    Objects carry idx, achieved, violates, distractor_in_zone, off_table; ``target`` is the number
    wanted and constant within an episode.
    """
    counted = objects.groupBy("idx").agg(
        F.count_if("achieved").alias("achieved"),
        F.bool_or("violates").alias("violated"),
        F.bool_or("distractor_in_zone").alias("distracted"),
        F.bool_or(F.col("off_table") & ~F.col("achieved")).alias("off_table"),
        F.max(target).alias("target"),
    )
    barred = F.col("violated") | F.col("distracted")
    return counted.select(
        "idx",
        "achieved",
        (~barred & (F.col("achieved") == F.col("target"))).alias("success"),
        F.when(barred | (F.col("achieved") > F.col("target")), F.lit(True))
        .when(F.col("achieved") == F.col("target"), F.lit(False))
        .otherwise(F.col("off_table"))
        .alias("failure"),
    )


def order_violations(goals: DataFrame) -> DataFrame:
    """Episodes in which a later goal is done before the current one.

    Goals carry idx, k, done.  The current goal is the first one not done.  The last goal restores
    the start, so it does not count while the object is already back.
    """
    state = goals.groupBy("idx").agg(
        F.min(F.when(~F.col("done"), F.col("k"))).alias("current"),
        F.max("k").alias("last"),
    )
    done = goals.where("done").join(large(state), "idx")
    early = done.where((F.col("k") > F.col("current")) & (F.col("k") < F.col("last")))
    return state.join(large(early.select("idx").distinct().withColumn("early", F.lit(True))), "idx", "left").select(
        "idx", "current", F.coalesce("early", F.lit(False)).alias("violated")
    )


#: Steps of an episode are folded in slices of so many, which bounds the arrays.
SLICE_STEPS = 4096


def _popped(marks: Column, goals: int, start: Column) -> Column:
    """The state after steps (t, mask) in order: goals popped so far, their times, the first violation.

    A step pops the current goal if its bit is set.  If it is not, the bit of a later goal but the
    last is a violation; goals popped before do not count any more.
    """
    between = lambda state: F.lit((1 << max(goals - 1, 0)) - 1) - (F.call_function("shiftleft", F.lit(2), state["done"]) - 1)

    def step(state: Column, mark: Column) -> Column:
        open_ = state["done"] < goals
        hit = open_ & (F.getbit(mark["mask"], state["done"]) == 1)
        early = open_ & ~hit & (between(state) > 0) & (mark["mask"].bitwiseAND(between(state)) != 0)
        return F.struct(
            (state["done"] + hit.cast("int")).alias("done"),
            F.when(hit, F.concat(state["times"], F.array(mark["t"]))).otherwise(state["times"]).alias("times"),
            F.coalesce(state["early"], F.when(early, mark["t"])).alias("early"),
        )

    kind = "struct<done:int,times:array<bigint>,early:bigint>"
    first = F.struct(
        start.cast("int").alias("done"),
        F.array().cast("array<bigint>").alias("times"),
        F.lit(None).cast("bigint").alias("early"),
    ).cast(kind)
    return F.aggregate(marks, first, lambda state, mark: step(state, mark).cast(kind))


def follow_goals(steps: DataFrame, goals: list[Column], skipped: list[bool] | None = None) -> DataFrame:
    """(idx, times, goals_done, violated_at): an episode's goals, checked strictly in order, one per step.

    ``goals[k]`` tells from a step whether goal k holds; skipped goals are the oracle's only.
    ``times`` are the steps at which goals were popped; a popped goal that no longer holds stays
    popped.  ``violated_at`` is the first step at which a later goal (the last one, which restores
    the start, does not count) holds while the current one does not.

    One pass: slices of steps (``t`` from 0 on) are folded from every state they may start in, next to the
    data, and an episode joins its slices, so no array holds more than ``SLICE_STEPS`` steps or one entry per
    slice.
    """
    rounds = [g for k, g in enumerate(goals) if not (skipped and skipped[k])]
    m = len(rounds)
    mask = sum((F.when(holds, F.lit(1 << k)).otherwise(0) for k, holds in enumerate(rounds)), F.lit(0))
    marked = F.when(F.col("mask") != 0, F.struct(F.col("t").cast("bigint").alias("t"), F.col("mask").cast("int").alias("mask")))
    slices = (
        steps.select("idx", "t", mask.alias("mask"))
        .groupBy("idx", F.floor(F.col("t") / SLICE_STEPS).alias("slice"))
        .agg(F.sort_array(F.collect_list(marked)).alias("marks"))
    )
    # nothing is popped before an episode's first slice, often its only one
    starts = F.when(F.col("slice") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(m)))
    folded = slices.select("idx", "slice", F.transform(starts, lambda s: _popped(F.col("marks"), m, s)).alias("ends"))
    episodes = folded.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("slice", "ends"))).alias("slices"))
    kind = "struct<done:int,times:array<bigint>,early:bigint>"
    first = F.struct(
        F.lit(0).alias("done"), F.array().cast("array<bigint>").alias("times"), F.lit(None).cast("bigint").alias("early")
    ).cast(kind)

    def join(state: Column, part: Column) -> Column:
        end = F.get(part["ends"], state["done"])
        return F.struct(
            end["done"].alias("done"),
            F.concat(state["times"], end["times"]).alias("times"),
            F.coalesce(state["early"], end["early"]).alias("early"),
        ).cast(kind)

    whole = episodes.select("idx", F.aggregate("slices", first, join).alias("state"))
    return whole.select(
        "idx",
        F.col("state.times").alias("times"),
        F.col("state.done").alias("goals_done"),
        F.col("state.early").alias("violated_at"),
    )


def pop_goals(steps: DataFrame, goals: list[Column], skipped: list[bool] | None = None) -> DataFrame:
    """(idx, t1, t2, ..., goals_done): when each goal is completed, see :func:`follow_goals`."""
    rounds = len(goals) - sum(skipped or [])
    times = [F.get("times", F.lit(k)).alias(f"t{k + 1}") for k in range(rounds)]
    return follow_goals(steps, goals, skipped).select("idx", *times, "goals_done")
