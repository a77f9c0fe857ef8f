"""Running metrics, an episode buffer and an episode log as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from episodium.operators.evaluation import metric_rows
from episodium.sources.shards import Folder
from episodium.workspace import discard


def file_stream(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files per batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .option("pathGlobFilter", pattern)
        .parquet(path)
    )


def deduplicated(steps: DataFrame, arrival: str, keys: list[str], delay: str) -> DataFrame:
    """Steps without repeated deliveries; state is kept no longer than ``delay``."""
    return steps.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(keys)


# --- running metrics --------------------------------------------------------------------------------


def running_sums(episodes: DataFrame) -> DataFrame:
    """Sums per (partition, task) over all episodes so far."""
    return episodes.groupBy("partition", "task").agg(
        F.count(F.lit(1)).alias("seen"),
        F.sum(F.col("is_successful_at_end").cast("int")).alias("won"),
        F.sum("steps_taken").alias("steps"),
    )


def with_total(sums: DataFrame) -> DataFrame:
    """Metric rows of the sums and of their grand total, in one pass over the sums."""
    both = sums.groupingSets([["partition", "task"], []], "partition", "task").agg(
        F.grouping_id().alias("level"),
        F.sum("seen").alias("seen"),
        F.sum("won").alias("won"),
        F.sum("steps").alias("steps"),
    )
    return metric_rows(both.where(F.col("seen") > 0))


def publish_metrics(episodes: DataFrame, path: str, checkpoint: str):
    """Write the metrics after every batch; each batch replaces its own folder, so a retry is safe.

    The sums have one row per (partition, task), however many episodes there are.
    """

    def publish(sums: DataFrame, epoch: int) -> None:
        with_total(sums).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        running_sums(episodes)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of the last published batch."""
    published = spark.read.parquet(path)
    newest = published.agg(F.max("epoch")).scalar()
    return published.where(F.col("epoch") == newest).drop("epoch")


# --- episode buffer --------------------------------------------------------------------------------

STEP_SCHEMA = "idx bigint, t bigint, success boolean, reason string, is_last boolean, arrived timestamp"
CLOSED_SCHEMA = "idx bigint, steps_taken bigint, recorded string, final_success boolean, reason string"
#: What is held between batches: a row per step of an open episode, one without a step per closed one.
HELD_SCHEMA = "idx bigint, t bigint, success boolean, reason string, is_last boolean, expires bigint, closed boolean"
#: What becomes of the episodes of a batch: rows that are held, and rows of ended episodes.
_FOLLOWED_SCHEMA = f"{HELD_SCHEMA}, steps_taken bigint, recorded string, final_success boolean, ended boolean"
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_FOLLOWED = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in _FOLLOWED_SCHEMA.split(", "))])
_FOLLOWED_ROWS = 8192


def leading_steps(held: Iterable[tuple]) -> list[tuple]:
    """The steps (t, success, reason, is_last) from 0 on without a gap, each once."""
    by_time = {}
    for step in held:
        by_time.setdefault(step[0], step)
    steps = []
    while len(steps) in by_time:
        steps.append(by_time[len(steps)])
    return steps


def end_of(steps: list[tuple], max_steps: int) -> tuple[int, str] | None:
    """(number of steps, reason) at which gapless steps end: a stop reason, the end mark or the limit."""
    for t, _, reason, is_last in steps:
        if reason is not None or is_last or t == max_steps - 1:
            return t + 1, reason or ("end" if is_last else "limit")
    return None


def outcome(idx: int, steps: list[tuple], reason: str) -> Row:
    """The row of an ended episode: a pointless step is not recorded, a failed one is no success."""
    seen = [success and why != "failed" for _, success, why, _ in steps if why != "pointless"]
    return Row(
        idx=idx,
        steps_taken=len(steps),
        recorded="".join("1" if won else "0" for won in seen),
        final_success=bool(seen and seen[-1]),
        reason=reason,
    )


def follow(idx: int, rows: Iterable[tuple], max_steps: int, keep_ms: int, before: int, now: int) -> Iterator[tuple]:
    """Rows of ``_FOLLOWED_SCHEMA`` for one episode, from those held and, after them, its new steps.

    ``rows`` are (idx, new, t, success, reason, is_last, at, closed), where ``at`` is when a held
    episode expires or a new step arrived; ``before`` and ``now`` are the newest arrivals up to the
    last batch and this one.
    """
    steps, expires, closed, newest = {}, 0, False, None
    for _, new, t, success, reason, is_last, at, was_closed in rows:
        if not new:
            expires, closed = at, was_closed
        if not closed and t not in steps:
            steps[t] = (t, success, reason, is_last)
            if new:
                newest = at if newest is None else max(newest, at)
    if newest is not None:
        wait = max(newest, before) + keep_ms
        leading = leading_steps(steps.values())
        end = end_of(leading, max_steps)
        closed = end is not None
        expires = wait if closed else max(wait, expires)
        if closed:
            yield _ended(outcome(idx, leading[: end[0]], end[1]))
    if expires <= now:
        if not closed:
            yield _ended(outcome(idx, leading_steps(steps.values()), "timeout"))
    elif closed:
        yield (idx, None, None, None, None, expires, True, None, None, None, False)
    else:
        for step in steps.values():
            yield (idx, *step, expires, False, None, None, None, False)


def _ended(row: Row) -> tuple:
    return (row.idx, None, None, row.reason, None, None, None, row.steps_taken, row.recorded, row.final_success, True)


def _followed(max_steps: int, keep_ms: int, before: int, now: int):
    """:func:`follow` for Arrow batches that are sorted by episode, held rows before new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        followed = chain.from_iterable(
            follow(idx, episode, max_steps, keep_ms, before, now) for idx, episode in groupby(rows, itemgetter(0))
        )
        while some := list(islice(followed, _FOLLOWED_ROWS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, field.type) for values, field in zip(zip(*some), _FOLLOWED)], schema=_FOLLOWED
            )

    return run


class EpisodeBuffer:
    """Batches of steps become rows of ended episodes; what is open waits in a table for the next batch.

    The newest arrival is the clock.  An episode expires ``keep_ms`` after its newest step that was
    new: an open one comes out with the steps it has without a gap and the reason ``timeout``, and a
    closed one is forgotten; until then repeated and later steps of a closed episode are dropped.
    Each batch writes what is held anew, next to the stream's checkpoint, so that a batch that is
    tried again starts from the same rows; its files at ``path`` bear its number and are replaced.
    """

    def __init__(self, max_steps: int, keep_ms: int, path: str, checkpoint: str) -> None:
        self.max_steps, self.keep_ms, self.path = max_steps, keep_ms, path
        self.state = f"{checkpoint}/episodes"

    def __call__(self, steps: DataFrame, epoch: int) -> None:
        spark = steps.sparkSession
        table, clock = f"{self.state}/{epoch}", f"{self.state}/clock-{epoch}"
        for path in (table, clock):  # left by an attempt that failed
            discard(spark, path)
        before = self._clock(spark, epoch - 1) if epoch else 0
        now = max(before, steps.agg(F.max(F.unix_millis("arrived"))).first()[0] or 0)
        spark.range(1).select(F.lit(now).cast("bigint").alias("now")).write.parquet(clock)
        rows = steps.select(
            "idx", F.lit(True).alias("new"), "t", "success", "reason", "is_last",
            F.coalesce(F.unix_millis("arrived"), F.lit(now)).alias("at"), F.lit(False).alias("closed"),
        )
        if epoch:
            rows = rows.unionByName(self._rows(spark, epoch - 1).where("NOT ended").select(
                "idx", F.lit(False).alias("new"), "t", "success", "reason", "is_last", F.col("expires").alias("at"), "closed"
            ))
        followed = (
            rows.repartition("idx").sortWithinPartitions("idx", "new")
            .mapInArrow(_followed(self.max_steps, self.keep_ms, before, now), _FOLLOWED_SCHEMA)
        )
        followed.write.partitionBy("ended").parquet(table)
        self._publish(spark, epoch)
        if epoch > 1:
            discard(spark, f"{self.state}/{epoch - 2}")
            discard(spark, f"{self.state}/clock-{epoch - 2}")

    def _rows(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.schema(_FOLLOWED_SCHEMA).parquet(f"{self.state}/{epoch}")

    def _clock(self, spark: SparkSession, epoch: int) -> int:
        return spark.read.schema("now bigint").parquet(f"{self.state}/clock-{epoch}").first()[0]

    def _publish(self, spark: SparkSession, epoch: int) -> None:
        """Move the batch's ended episodes in place, from a folder that readers do not see."""
        folder, staging, name = Folder(spark, self.path), f"_batch-{epoch}", f"batch-{epoch:010d}-"
        folder.remove(staging)
        for old in folder.names():
            if old.startswith(name):
                folder.remove(old)
        ended = self._rows(spark, epoch).where("ended").select("idx", "steps_taken", "recorded", "final_success", "reason")
        ended.write.parquet(f"{self.path}/{staging}")
        for file in folder.files_below(staging):
            if file.endswith(".parquet"):
                folder.move(file, name + file.rsplit("/", 1)[-1])
        folder.remove(staging)


class Buffered(NamedTuple):
    """A stream of steps and how its episodes end, see :func:`buffer_episodes`."""

    steps: DataFrame
    max_steps: int
    keep_ms: int


def buffer_episodes(steps: DataFrame, max_steps: int, keep_minutes: int = 60) -> Buffered:
    """Ended episodes from a stream of steps that may arrive in any order, and more than once.

    An episode ends when every step from the start up to a stop reason, the end mark or the limit
    has arrived; one that waits ``keep_minutes`` of arrival time (``arrived``) for more comes out
    with the reason ``timeout``, so that none is lost.  Steps at or beyond the limit are dropped
    before the shuffle, since an episode cannot use them; none holds more than ``max_steps``.
    """
    return Buffered(steps.where(F.col("t") < max_steps), max_steps, keep_minutes * 60_000)


def start_buffer(ended: Buffered, path: str, checkpoint: str, **trigger):
    """Append the rows of :func:`buffer_episodes` to a Parquet table.

    A restart from ``checkpoint`` goes on with the open episodes, also on other numbers of cores or
    executors.
    """
    Folder(ended.steps.sparkSession, path).make()
    return (
        ended.steps.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(EpisodeBuffer(ended.max_steps, ended.keep_ms, path, checkpoint))
        .start()
    )


def log_stream(rows: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet log, one folder per batch; a retried batch replaces its folder.

    Streams with further columns may write to the same log; readers merge the schemas.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(append)
        .start()
    )


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Everything logged, with columns a batch lacks as NULL."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*paths)
