"""Building and splitting episode datasets."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodium import dims
from episodium.functions.keyed import keyed_hash
from episodium.functions.ranking import contiguous_share, dense_index, hash_index, sliced_index

# --- assembling nested rows -----------------------------------------------------------------------


def nest(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of a group as one array, ordered by ``t``: one row per group, however long it is."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", *fields))).alias(name))


def sort_records(records: Column, field: str) -> Column:
    """Array of structs by one field; records with equal fields keep their order."""
    tagged = F.transform(
        records, lambda r, i: F.struct(r[field].alias("k"), i.alias("i"), r.alias("r"))
    )
    return F.transform(F.array_sort(tagged), lambda p: p["r"])


def parse_episodes(
    headers: DataFrame, actions: DataFrame, observations: DataFrame, fields: list[str]
) -> DataFrame:
    """Headers with nested actions and observations; both must have the same number of elements.

    Episodes that break the rule keep their counts under ``status = 'reject'`` and carry no arrays.
    """
    both = actions.select("idx", "t", *fields, F.lit("a").alias("part_of")).unionByName(
        observations.select("idx", "t", *fields, F.lit("o").alias("part_of"))
    )
    is_action = F.col("part_of") == "a"
    item = F.struct("t", *fields)
    nested = both.groupBy("idx").agg(
        F.count(F.when(is_action, 1)).alias("n_actions"),
        F.count(F.when(~is_action, 1)).alias("n_obs"),
        F.sort_array(F.collect_list(F.when(is_action, item))).alias("actions"),
        F.sort_array(F.collect_list(F.when(~is_action, item))).alias("observations"),
    )
    zero = F.lit(0).cast("bigint")
    none = F.array().cast(nested.schema["actions"].dataType)
    counted = headers.join(nested, "idx", "left").withColumns(
        {"n_actions": F.coalesce("n_actions", zero), "n_obs": F.coalesce("n_obs", zero)}
    )
    ok = F.col("n_actions") == F.col("n_obs")
    return counted.select(
        *headers.columns,
        "n_actions",
        "n_obs",
        F.when(ok, F.coalesce("actions", none)).alias("actions"),
        F.when(ok, F.coalesce("observations", none)).alias("observations"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("reject")).alias("status"),
    )


def append_null_action(headers: DataFrame, steps: DataFrame, start: dict[str, float]) -> DataFrame:
    """Steps plus one last step per episode that holds the starting pose."""
    counts = steps.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    nulls = headers.join(counts, "idx", "left").select(
        "idx",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("t"),
        *[F.lit(value).alias(name) for name, value in start.items()],
    )
    return steps.select("idx", "t", *start).unionByName(nulls)


def truncate_observations(observations: DataFrame, actions: DataFrame) -> DataFrame:
    """Observations that have an action."""
    counts = actions.groupBy("idx").agg(F.count(F.lit(1)).alias("n_actions"))
    return observations.join(counts, "idx").where(F.col("t") < F.col("n_actions")).drop("n_actions")


def demonstration_tracker(steps: DataFrame, outcomes: DataFrame, null_action_kept: bool) -> DataFrame:
    """Per-step success of a demonstration: its last step only, or the last two with a null action."""
    counts = steps.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    last = 2 if null_action_kept else 1
    return (
        steps.select("idx", "t")
        .join(counts.join(outcomes, "idx"), "idx")
        .select(
            "idx",
            "t",
            (F.col("is_successful_at_end") & (F.col("t") >= F.col("n") - last)).alias("success"),
        )
    )


def instance_metadata(headers: DataFrame, poses: DataFrame, objects: DataFrame) -> DataFrame:
    """One summary row per episode: counts, group, scene contents, first and last pose."""
    start = ["p0x", "p0y", "p0z", "r0x", "r0y", "r0z", "r0w"]
    end = ["p1x", "p1y", "p1z", "r1x", "r1y", "r1z", "r1w"]
    moves = poses.groupBy("idx").agg(
        F.count(F.lit(1)).alias("num_actions"),
        F.min_by(F.struct(*start), "t").alias("first"),
        F.max_by(F.struct(*end), "t").alias("last"),
    )
    scene = objects.groupBy("idx").agg(
        F.countDistinct("part").alias("num_objects"),
        F.array_sort(F.collect_set("noun")).alias("shapes"),
        F.array_sort(F.collect_set("texture")).alias("textures"),
        F.array_sort(F.collect_set("description")).alias("object_types"),
    )
    group = F.try_element_at(
        F.create_map(*[F.lit(x) for item in dims.GROUP_OF_TASK.items() for x in item]), F.col("task")
    )
    zero = F.lit(0).cast("bigint")
    return (
        headers.join(moves, "idx", "left")
        .join(scene, "idx", "left")
        .select(
            *headers.columns,
            group.alias("task_group"),
            F.coalesce("num_actions", zero).alias("num_actions"),
            F.coalesce("num_objects", zero).alias("num_objects"),
            F.coalesce("shapes", F.array().cast("array<string>")).alias("shapes"),
            F.coalesce("textures", F.array().cast("array<string>")).alias("textures"),
            F.coalesce("object_types", F.array().cast("array<string>")).alias("object_types"),
            "first",
            "last",
        )
    )


def value_counters(objects: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Counts per (episode, kind, value) of several attributes in one pass."""
    entries = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in kinds.items()]
    )
    return (
        objects.select("idx", F.explode(entries).alias("e"))
        .groupBy("idx", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- splits, shares and batches --------------------------------------------------------------------


def validation_quota(rows: DataFrame, total: int, by: str = "task") -> DataFrame:
    """Validation rows per task in proportion to its size, rounded down (the sum may fall short)."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    everything = counts.agg(F.sum("n")).scalar()
    return counts.select(
        by,
        "n",
        F.floor(F.lit(total) * (F.col("n").cast("double") / everything.cast("double"))).alias("quota"),
    )


def stratified_split(rows: DataFrame, total: int, seed: object, key: str = "idx", by: str = "task") -> DataFrame:
    """Train/valid split with an exact number of validation rows per task, keyed by the row key."""
    hashed = rows.withColumn("__h", keyed_hash(seed, key))
    ranked = hash_index(hashed, [by], "__h", [key], "__rank")
    quota = validation_quota(rows, total, by).select(by, "quota")
    return (
        ranked.join(quota, by)
        .withColumn(
            "split", F.when(F.col("__rank") < F.col("quota"), F.lit("valid")).otherwise(F.lit("train"))
        )
        .select(*rows.columns, "split")
    )


def rank_share(rows: DataFrame, key: str, world: int | None, name: str = "rank") -> DataFrame:
    """Contiguous share of the rows per rank; no rank when there is no world."""
    if world is None:
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return dense_index(rows, key, "__i").withColumn(
        name, contiguous_share(F.col("__i"), total, world)
    ).drop("__i")


def index_range(rows: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows whose dense position is in ``[start, end)``."""
    indexed = dense_index(rows, key, "i")
    return indexed.where((F.col("i") >= start) & (F.col("i") < end))


def shuffled_batches(rows: DataFrame, key: str, size: int, seed: object, drop_last: bool = True) -> DataFrame:
    """Batches over a keyed shuffle of all rows; an incomplete last batch is dropped on request."""
    hashed = rows.withColumn("__h", keyed_hash(seed, key))
    digest = F.col("__h")
    indexed = sliced_index(hashed, [], [digest, F.col(key)], [F.substring(digest, 1, 4)], "__i")
    batched = indexed.select(
        *rows.columns,
        F.floor(F.col("__i") / size).alias("batch"),
        (F.col("__i") % size).cast("bigint").alias("slot"),
    )
    if not drop_last:
        return batched
    full = rows.agg(F.floor(F.count(F.lit(1)) / size)).scalar()
    return batched.where(F.col("batch") < full)


def length_sorted_batches(rows: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """Batches of rows of about the same length, which need the least padding: ``batch`` and ``slot``.

    Rows are in order of (length, key); ranges between sampled quantiles keep the work even.
    """
    ordered = rows.withColumn("__order", F.struct(F.col(length).alias("n"), F.col(key).alias("k")))
    indexed = dense_index(ordered, "__order", "__i")
    return indexed.select(
        *rows.columns,
        F.floor(F.col("__i") / size).alias("batch"),
        (F.col("__i") % size).cast("bigint").alias("slot"),
    )


def rematerialise(assignment: DataFrame, contents: DataFrame, keys: list[str]) -> DataFrame:
    """New contents under an existing split; lost and unassigned rows are reported as such."""
    left = assignment.withColumn("__assigned", F.lit(True))
    right = contents.withColumn("__present", F.lit(True))
    status = (
        F.when(F.col("__present").isNull(), F.lit("missing"))
        .when(F.col("__assigned").isNull(), F.lit("unassigned"))
        .otherwise(F.lit("kept"))
    )
    return left.join(right, keys, "full").withColumn("status", status).drop("__assigned", "__present")


# --- columns ------------------------------------------------------------------------------------------


def flat_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, dotted name) of every leaf of a nested schema."""
    leaves = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            leaves += flat_fields(field.dataType, path + ".")
        else:
            leaves.append((path, path))
    return leaves


def flatten_struct(rows: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as flat columns with dotted names."""
    return rows.select(
        *[F.col(path).alias(name.replace(".", separator)) for path, name in flat_fields(rows.schema)]
    )


def dot_list(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``key=value`` strings of every leaf except the ``keep`` columns; missing values say ``null``."""
    entries = [
        F.struct(
            F.lit(name).alias("key"),
            F.concat(F.lit(name + "="), F.coalesce(F.col(path).cast("string"), F.lit("null"))).alias("entry"),
        )
        for path, name in flat_fields(rows.schema)
        if name not in keep
    ]
    return rows.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.key", "e.entry")


def matches(name: str, include: list[str] | None, exclude: list[str], precedence: str = "exclude") -> bool:
    """Whether a column name is selected by its globs; by default an exclusion wins."""
    excluded = any(fnmatch.fnmatch(name, p) for p in exclude)
    if include is None:
        return not excluded
    included = any(fnmatch.fnmatch(name, p) for p in include)
    return included if precedence == "include" else included and not excluded


def select_matching(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, precedence: str = "exclude") -> DataFrame:
    """Columns whose names match."""
    return rows.select(*[c for c in rows.columns if matches(c, include, exclude or [], precedence)])


def cast_matching(rows: DataFrame, types: dict[str | None, str]) -> DataFrame:
    """Columns cast by the first glob that matches; the key None catches all others."""

    def target(name: str) -> str | None:
        for pattern, kind in types.items():
            if pattern is not None and fnmatch.fnmatch(name, pattern):
                return kind
        return types.get(None)

    return rows.select(
        *[F.col(c).cast(target(c)).alias(c) if target(c) else F.col(c) for c in rows.columns]
    )


def diagonal_concat(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL and types widen."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def accept_reject(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with one boolean column per check and ``accepted`` for all of them."""
    every = F.lit(True)
    for check in checks.values():
        every = every & F.coalesce(check, F.lit(False))
    return rows.select(
        "*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()], every.alias("accepted")
    )


def decode_enum(value: Column, ids: dict[str, int]) -> Column:
    """Id from an id or any of its names; NULL if unknown."""
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for i in ids.items() for x in i]), value)
    number = value.try_cast("int")
    return F.coalesce(by_name, F.when(number.isin(sorted(set(ids.values()))), number))


def names_for_id(number: Column, ids: dict[str, int]) -> Column:
    """All names of an id, in the order they are defined."""
    per_id: dict[int, list[str]] = {}
    for name, value in ids.items():
        per_id.setdefault(value, []).append(name)
    pairs = []
    for value, names in per_id.items():
        pairs += [F.lit(value), F.array(*[F.lit(n) for n in names])]
    return F.try_element_at(F.create_map(*pairs), number)


# --- lookups by task ---------------------------------------------------------------------------------


def task_group(task: Column) -> Column:
    """The group of a task; NULL for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in dims.GROUP_OF_TASK.items() for x in item]), task)


def evaluation_filter(rows: DataFrame, partitions: list[int] | None = None, tasks: list[int] | None = None) -> DataFrame:
    """Rows of the given partitions and tasks; None stands for all."""
    for name, wanted in (("partition", partitions), ("task", tasks)):
        if wanted is not None:
            rows = rows.where(F.col(name).isin(wanted))
    return rows


def task_parameters(asked: DataFrame, parameters: DataFrame, value: str) -> DataFrame:
    """Rows with the parameters of their (partition, task), and ``missing`` where there are none."""
    return asked.join(parameters, ["partition", "task"], "left").withColumn("missing", F.col(value).isNull())
