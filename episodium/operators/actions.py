"""Pose actions as tokens, their masks, and losses over logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium import dims
from episodium.functions import pose as P
from episodium.functions.arrays import argmax, log_softmax_loss


def per_axis(rows: DataFrame, axes: dict[str, str], change) -> DataFrame:
    """Apply ``change(value, axis)`` to every pose column; ``axes`` maps column to axis."""
    others = [c for c in rows.columns if c not in axes]
    return rows.select(*others, *[change(F.col(c), axis).alias(c) for c, axis in axes.items()])


def normalise(rows: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Pose columns scaled to 0..1."""
    return per_axis(rows, axes, P.normalise)


def tokenise(rows: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Pose columns as tokens."""
    return per_axis(rows, axes, lambda v, a: P.discretise(P.normalise(v, a), a))


def detokenise(rows: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Token columns as pose values."""
    return per_axis(rows, axes, P.continuous)


def clamp(rows: DataFrame, axes: dict[str, str], drop_z: bool = True) -> DataFrame:
    """Pose columns cut to their bounds, without the height columns unless they are wanted."""
    cut = per_axis(rows, axes, P.clamp)
    return cut.drop(*[c for c, a in axes.items() if drop_z and a == "z"])


def timestep_masked(axes: list[str]) -> Column:
    """A timestep is masked only if every axis of every pose is ignored."""
    masked = F.lit(True)
    for axis in axes:
        masked = masked & (F.col(axis) == dims.IGNORED_TARGET)
    return masked


def target_tokens(rows: DataFrame, axes: dict[str, str]) -> DataFrame:
    """One row per (step, axis) with its target token; ignored axes keep the ignore value.

    Values are put under each other first, so that the token rule is compiled once, not per axis.
    """
    spec = [dims.AXIS_SPEC[a] for a in axes.values()]
    of_axis = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("axis"))
    low = of_axis([float(low) for low, _, _ in spec])
    width = of_axis([float(high) - float(low) for low, high, _ in spec])
    bins = of_axis([bins for _, _, bins in spec])
    token = F.when(F.col("value") == dims.IGNORED_TARGET, F.lit(dims.IGNORED_TARGET).cast("bigint")).otherwise(
        P.count_boundaries((F.col("value") - low) / width, bins)
    )
    values = rows.select("idx", "t", F.posexplode(F.array(*axes)).alias("axis", "value"))
    return values.select("idx", "t", "axis", token.alias("token"))


def token_ranges_ok(axes: dict[str, str]) -> Column:
    """Tokens within their number of bins; the height token is only checked from below."""
    ok = F.lit(True)
    for column, axis in axes.items():
        ok = ok & (F.col(column) >= 0)
        if axis != "z":
            ok = ok & (F.col(column) < dims.AXIS_SPEC[axis][2])
    return ok


def fine_grained_loss(logits: DataFrame) -> DataFrame:
    """Cross-entropy per (step, axis); NULL for ignored targets."""
    return logits.select(
        "step",
        "axis",
        "target",
        log_softmax_loss(F.col("logits"), F.col("target"), dims.IGNORED_TARGET).alias("loss"),
        argmax(F.col("logits")).alias("predicted"),
    )


def reduced_loss(losses: DataFrame) -> DataFrame:
    """Mean over the axes of a step, then over steps; a step with an ignored axis does not count."""
    per_step = losses.groupBy("step").agg(
        F.when(F.count(F.lit(1)) == F.count("loss"), F.avg("loss")).alias("loss")
    )
    return per_step.agg(F.count("loss").alias("steps"), F.avg("loss").alias("loss"))


AXIS_LABELS = [f"{pose}_{axis}" for pose, axes in sorted(dims.POSE_AXES.items()) for axis in axes]


def offline_metrics(losses: DataFrame) -> DataFrame:
    """Mean loss and accuracy per axis over targets that count."""
    counted = F.col("target") != dims.IGNORED_TARGET
    label = F.get(F.array(*[F.lit(x) for x in AXIS_LABELS]), F.col("axis").cast("int"))
    return losses.groupBy(label.alias("axis")).agg(
        F.count_if(counted).alias("targets"),
        F.avg("loss").alias("loss"),
        F.try_divide(
            F.count_if(counted & (F.col("predicted") == F.col("target"))), F.count_if(counted)
        ).alias("accuracy"),
    )


def exact_match(losses: DataFrame) -> DataFrame:
    """Share of steps whose counted axes are all right, and the number of steps seen."""
    counted = F.col("target") != dims.IGNORED_TARGET
    per_step = losses.groupBy("step").agg(
        F.bool_and(F.col("predicted") == F.col("target")).alias("ignore_blind"),
        F.coalesce(
            F.bool_and(F.when(counted, F.col("predicted") == F.col("target"))), F.lit(True)
        ).alias("right"),
    )
    return per_step.agg(
        F.count(F.lit(1)).alias("examples_seen"),
        (F.count_if("right") / F.count(F.lit(1))).alias("exact_match"),
    )


def decode_actions(logits: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Greedy tokens per step, cut into the pose parts; a step is at most 14 axes long.

    A step that lacks an axis, or has one too many, keeps its row: without parts, and ``status`` says so.
    """
    tokens = F.transform(
        F.sort_array(F.collect_list(F.struct("axis", argmax(F.col("logits")).alias("token")))),
        lambda p: p["token"],
    )
    steps = logits.groupBy("step").agg(tokens.alias("tokens"))
    whole = F.size("tokens") == sum(sizes.values())
    parts, start = [], 1
    for name, size in sizes.items():
        parts.append(F.when(whole, F.slice("tokens", start, size)).alias(name))
        start += size
    return steps.select("step", *parts, F.when(whole, F.lit("ok")).otherwise(F.lit("axes missing")).alias("status"))
