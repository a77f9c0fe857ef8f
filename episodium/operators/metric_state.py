"""Metrics that are updated batch by batch: a stored table of partial sums.

``update`` adds the sums of one batch, at the cost of that batch alone; ``merged`` adds up what is
stored; ``reset`` starts anew.  A batch has a name, and writing it again replaces it, so a replay
counts nothing twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodium import dims
from episodium.operators.actions import AXIS_LABELS
from episodium.operators.evaluation import metric_rows
from episodium.sources.tables import read_or_none
from episodium.workspace import discard


class MetricState:
    """Partial sums by group under a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], sums: dict[str, Column]) -> None:
        """``by`` are the columns of a group; ``sums`` are aggregates that add up over batches."""
        self.spark, self.path, self.by, self.sums = spark, path.rstrip("/"), by, sums

    def update(self, rows: DataFrame, batch: str) -> None:
        """Add a batch, or replace the batch of that name."""
        if not re.fullmatch("[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch's name is of letters, digits, hyphens and underscores")
        partial = rows.groupBy(*self.by).agg(*[value.alias(name) for name, value in self.sums.items()])
        partial.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def merged(self) -> DataFrame | None:
        """The sums over all batches, one row per group; None before the first batch."""
        stored = read_or_none(self.spark, self.path)
        if stored is None:
            return None
        return stored.groupBy(*self.by).agg(*[F.sum(name).alias(name) for name in self.sums])

    def reset(self) -> None:
        """Forget all batches."""
        discard(self.spark, self.path)


def online_state(spark: SparkSession, path: str) -> MetricState:
    """State of the online metrics, updated with evaluation episodes."""
    won = F.sum(F.col("is_successful_at_end").cast("long"))
    sums = {"seen": F.count(F.lit(1)), "won": won, "steps": F.sum("steps_taken")}
    return MetricState(spark, path, ["partition", "task"], sums)


def online_rows(state: MetricState) -> DataFrame | None:
    """(key, value) of the online metrics over all batches."""
    merged = state.merged()
    if merged is None:
        return None
    both = merged.groupingSets([["partition", "task"], []], "partition", "task").agg(
        F.grouping_id().alias("level"), *[F.sum(name).alias(name) for name in state.sums]
    )
    return metric_rows(both.where(F.col("seen") > 0))


def offline_state(spark: SparkSession, path: str) -> MetricState:
    """State of the per-axis loss and accuracy, updated with rows of losses."""
    counted = F.col("target") != dims.IGNORED_TARGET
    sums = {
        "targets": F.count_if(counted),
        "right": F.count_if(counted & (F.col("predicted") == F.col("target"))),
        "losses": F.count("loss"),
        "loss": F.sum("loss"),
    }
    return MetricState(spark, path, ["axis"], sums)


def offline_rows(state: MetricState) -> DataFrame | None:
    """Mean loss and accuracy per axis over all batches."""
    merged = state.merged()
    if merged is None:
        return None
    label = F.get(F.array(*[F.lit(x) for x in AXIS_LABELS]), F.col("axis").cast("int"))
    sums = merged.groupBy(label.alias("axis")).agg(*[F.sum(name).alias(name) for name in state.sums])
    return sums.select(
        "axis",
        "targets",
        F.try_divide("loss", "losses").alias("loss"),
        F.try_divide("right", "targets").alias("accuracy"),
    )
