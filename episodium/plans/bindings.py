"""How the given tables stand in for episode data, in Spark and as SQL text.

orders = episode headers, lineitem = steps, part = objects, customer/supplier = runs,
embeddings = logits or 8x8 frames, conversations/documents = free text, events = a step stream.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodium import dims
from episodium.functions.ranking import running_index

TASK_NAME_OF_PRIORITY = {
    "1-URGENT": "simple_manipulation",
    "2-HIGH": "rotate",
    "3-MEDIUM": "sweep",
    "4-NOT SPECIFIED": "pick_in_order_then_restore",
    "5-LOW": "novel_adj",
}
PARTITION_NAME_OF_STATUS = {
    "F": "placement_generalization",
    "O": "combinatorial_generalization",
    "P": "novel_object_generalization",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lookup(mapping: dict, key: Column) -> Column:
    """Literal lookup; NULL for an unknown key."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def sql_lookup(mapping: dict, key: str) -> str:
    """:func:`lookup` as SQL text."""

    def literal(x: object) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x)

    cases = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    return f"CASE {key} {cases} END"


def sql_text(value: str) -> str:
    """A quoted SQL string."""
    return "'" + value.replace("'", "''") + "'"


def sql_values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A small literal table as a SQL CTE."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return sql_text(x)
        return str(x)

    body = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


# --- episode headers -----------------------------------------------------------------------------


def instances(spark: SparkSession, folder: str) -> DataFrame:
    """Episode headers: one row per episode."""
    orders = table(spark, folder, "orders")
    task_name = lookup(TASK_NAME_OF_PRIORITY, F.col("o_orderpriority"))
    partition_name = lookup(PARTITION_NAME_OF_STATUS, F.col("o_orderstatus"))
    return orders.select(
        F.col("o_orderkey").alias("idx"),
        task_name.alias("task_name"),
        lookup(dims.TASK_IDS_BY_ANY_NAME, task_name).alias("task"),
        partition_name.alias("partition_name"),
        lookup(dims.PARTITIONS, partition_name).alias("partition"),
        F.col("o_custkey").alias("seed"),
        F.col("o_totalprice").alias("price"),
    )


INSTANCES = f"""instances AS (
  SELECT o_orderkey AS idx, {sql_lookup(TASK_NAME_OF_PRIORITY, "o_orderpriority")} AS task_name,
    {sql_lookup({k: dims.TASK_IDS_BY_ANY_NAME[v] for k, v in TASK_NAME_OF_PRIORITY.items()}, "o_orderpriority")} AS task,
    {sql_lookup(PARTITION_NAME_OF_STATUS, "o_orderstatus")} AS partition_name,
    {sql_lookup({k: dims.PARTITIONS[v] for k, v in PARTITION_NAME_OF_STATUS.items()}, "o_orderstatus")} AS partition,
    o_custkey AS seed, o_totalprice AS price
  FROM orders)"""


# --- steps ---------------------------------------------------------------------------------------

STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def steps(spark: SparkSession, folder: str, *extra: str, tasks: int | None = None) -> DataFrame:
    """Episode steps with their time index ``t``.  ``extra`` names further lineitem columns.

    ``tasks`` says over how many tasks episodes are dealt, for callers whose rows get wider later.
    """
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", *STEP_ORDER, "l_returnflag", *extra
    )
    if tasks is not None:
        items = items.repartition(tasks, "l_orderkey")
    indexed = running_index(items, ["l_orderkey"], [F.col(c) for c in STEP_ORDER])
    return indexed.select(
        F.col("l_orderkey").alias("idx"),
        "t",
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_returnflag") == "R").alias("success"),
        *[zero_safe(c) for c in extra],
    )


def zero_safe(name: str) -> Column:
    """A column by name; the two fractions lose the sign of a negative zero."""
    if name in ("l_discount", "l_tax"):
        return (F.col(name) + F.lit(0.0)).alias(name)
    return F.col(name)


STEPS = f"""steps AS (
  SELECT l_orderkey AS idx,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(STEP_ORDER)}) - 1 AS t,
    l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity AS qty,
    l_extendedprice AS price, l_returnflag AS flag, l_returnflag = 'R' AS success,
    l_linestatus, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax
  FROM lineitem)"""


# --- poses ------------------------------------------------------------------------------------

# axis -> value of a step; shared by both engines because it is plain arithmetic
POSE_EXPRESSIONS = {
    "p0x": "0.25 + qty / 100.0",
    "p0y": "l_discount * 10.0 - 0.5",
    "p0z": "l_tax * 4.0",
    "r0x": "qty / 25.0 - 1.0",
    "r0y": "l_discount * 20.0 - 1.0",
    "r0z": "l_tax * 25.0 - 1.0",
    "r0w": "1.0 - l_tax * 10.0",
    "p1x": "0.76 - qty / 100.0",
    "p1y": "0.6 - l_discount * 12.0",
    "p1z": "0.32 - l_tax * 5.0",
    "r1x": "l_tax * 12.5 - 0.5",
    "r1y": "qty / 50.0 - 0.5",
    "r1z": "l_discount * 10.0 - 0.5",
    "r1w": "1.0 - l_discount * 5.0",
}
POSE_AXIS = {
    name: ("rot" if name[0] == "r" else name[2]) for name in POSE_EXPRESSIONS
}
# a step with flag N in status F is padding: all axes ignored; flag N in status O: rotation only
PADDED = "(flag = 'N' AND l_linestatus = 'F')"
HALF_PADDED = "(flag = 'N' AND l_linestatus = 'O')"


def _double(expression: str) -> str:
    """Number literals as doubles, so that neither engine uses decimals."""
    return re.sub(r"(\d+\.\d+)(?!e)", r"\1e0", expression)


def raw_pose_sql(name: str) -> str:
    """Pose axis of a step without padding."""
    return _double(POSE_EXPRESSIONS[name])


def padded_pose_sql(name: str) -> str:
    """Pose axis of a step, -100 where the step is padding."""
    hidden = PADDED if name[0] == "p" else f"({PADDED} OR {HALF_PADDED})"
    return f"CASE WHEN {hidden} THEN -100.0e0 ELSE {raw_pose_sql(name)} END"


def poses(spark: SparkSession, folder: str, padded: bool = False, tasks: int | None = None) -> DataFrame:
    """Steps with the fourteen axes of their two poses."""
    expression = padded_pose_sql if padded else raw_pose_sql
    frame = steps(spark, folder, "l_discount", "l_tax", "l_linestatus", tasks=tasks)
    return frame.select("*", *[F.expr(expression(n)).alias(n) for n in POSE_EXPRESSIONS])


def poses_sql(padded: bool = False) -> str:
    """:func:`poses` as SQL CTEs."""
    expression = padded_pose_sql if padded else raw_pose_sql
    axes = ", ".join(f"{expression(n)} AS {n}" for n in POSE_EXPRESSIONS)
    return f"{STEPS}, poses AS (SELECT *, {axes} FROM steps)"


# --- episode outcomes ----------------------------------------------------------------------------

LIMIT_COLUMNS = {
    "max_swept_obj": "CASE WHEN seed % 11 = 0 THEN NULL ELSE seed % 5 + 1 END",
    "num_dragged_obj": "CASE WHEN seed % 11 = 0 THEN NULL ELSE seed % 4 + 2 END",
    "num_base_obj": "seed % 4",
    "num_target_base_obj": "CASE WHEN seed % 11 = 0 THEN NULL ELSE seed % 3 + 3 END",
}


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes with raw outcome: steps taken, final success, object counts."""
    items = table(spark, folder, "lineitem")
    done = items.groupBy(F.col("l_orderkey").alias("idx")).agg(
        F.count(F.lit(1)).alias("steps_taken"),
        F.max(F.struct(*STEP_ORDER, (F.col("l_returnflag") == "R").alias("s")))["s"].alias("last"),
    )
    return (
        instances(spark, folder)
        .join(done, "idx", "left")
        .select(
            "idx", "task", "task_name", "partition", "partition_name", "seed", "price",
            F.coalesce("steps_taken", F.lit(0)).cast("bigint").alias("steps_taken"),
            F.coalesce("last", F.lit(False)).alias("is_successful_at_end"),
            *[F.expr(e).cast("bigint").alias(c) for c, e in LIMIT_COLUMNS.items()],
        )
    )


_LIMITS = ", ".join(f"CAST({e} AS BIGINT) AS {c}" for c, e in LIMIT_COLUMNS.items())
OUTCOMES = f"""{INSTANCES}, {STEPS}, ended AS (
  SELECT idx, count(*) AS steps_taken, arg_max(success, t) AS last FROM steps GROUP BY idx),
outcomes AS (
  SELECT i.*, coalesce(e.steps_taken, 0) AS steps_taken, coalesce(e.last, false) AS is_successful_at_end,
    {_LIMITS}
  FROM instances i LEFT JOIN ended e USING (idx))"""
TIME_LIMIT_SQL = """CASE WHEN task IN (11, 12) THEN max_swept_obj
    WHEN task = 16 THEN num_target_base_obj
    WHEN task IN (5, 7) THEN 1 ELSE num_dragged_obj END"""
EPISODES = f"""{OUTCOMES}, limits AS (SELECT *, CAST({TIME_LIMIT_SQL} AS BIGINT) AS time_limit FROM outcomes),
episodes AS (SELECT *, CASE WHEN is_successful_at_end THEN time_limit - steps_taken >= 0 ELSE false END AS strict
  FROM limits)"""


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes with time limit and strict success."""
    from episodium.operators.evaluation import with_strict_success, with_time_limit

    return outcomes(spark, folder).transform(with_time_limit).transform(with_strict_success)


# --- objects ------------------------------------------------------------------------------------


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Objects: texture and noun from the part name."""
    words = F.split("p_name", " ")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("part"),
        words[0].alias("texture"),
        words[1].alias("noun"),
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("retail"),
    )


PARTS = """parts AS (
  SELECT p_partkey AS part, split_part(p_name, ' ', 1) AS texture, split_part(p_name, ' ', 2) AS noun,
    p_name AS description, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS retail
  FROM part)"""


# --- 8x8 frames and logits ---------------------------------------------------------------------


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """8x8 segmentation frames: pixel id from the size of an embedding value."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("frame"),
        F.transform(
            "embedding", lambda e: F.least(F.floor(F.abs(e.cast("double")) * 20), F.lit(7)).cast("int")
        ).alias("ids"),
        F.transform("embedding", lambda e: F.abs(e.cast("double"))).alias("grey"),
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Frames as one row per pixel."""
    return (
        frames(spark, folder)
        .select("frame", F.posexplode(F.arrays_zip("ids", "grey")).alias("at", "px"))
        .select(
            "frame",
            F.floor(F.col("at") / 8).alias("y"),
            (F.col("at") % 8).cast("bigint").alias("x"),
            F.col("px.ids").alias("id"),
            F.col("px.grey").alias("grey"),
        )
    )


PIXELS = """pixels AS (
  SELECT frame, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x,
    CAST(least(floor(abs(e) * 20), 7) AS INTEGER) AS id, abs(e) AS grey
  FROM (SELECT vec_id AS frame, unnest(range(1, 65)) AS pos,
      CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings))"""


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Logit vectors: axis, timestep and target; every tenth vector has an ignored target."""
    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 14).alias("step"),
        (F.col("vec_id") % 14).cast("bigint").alias("axis"),
        F.transform("embedding", lambda e: e.cast("double") * F.lit(10.0)).alias("logits"),
        F.when(F.col("vec_id") % 10 == 3, F.lit(dims.IGNORED_TARGET))
        .otherwise(F.col("label"))
        .cast("bigint")
        .alias("target"),
    )


LOGITS = """logits AS (
  SELECT vec_id // 14 AS step, vec_id % 14 AS axis,
    list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 10.0) AS logits,
    CAST(CASE WHEN vec_id % 10 = 3 THEN -100 ELSE label END AS BIGINT) AS target
  FROM embeddings)"""
