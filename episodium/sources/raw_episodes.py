"""Raw episodes: one folder per episode below a folder per task, as JSON files.

``{root}/{task}/{index}/`` holds ``trajectory.json`` (header, object and prompt assets), ``actions.json``
(parallel arrays of poses) and ``observations.json`` (an array of observations).  All files are read
by one scan, and an episode's files meet in one shuffle of the parsed rows.  A folder that cannot be
read as an episode comes back as a row with a ``status`` that says why.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodium import dims

_POSE = "array<array<double>>"
TRAJECTORY = (
    "steps bigint, success boolean, seed bigint, end_effector_type string, prompt string, "
    "prompt_assets map<string,array<struct<name:string,texture:string>>>, "
    "obj_id_to_info map<string,struct<obj_name:string,obj_assets:string,texture_name:string>>"
)
ACTIONS = f"pose0_position {_POSE}, pose0_rotation {_POSE}, pose1_position {_POSE}, pose1_rotation {_POSE}"
OBSERVATION = "index bigint, front string, top string"
_KINDS = {
    "trajectory": f"struct<{', '.join(p.replace(' ', ':', 1) for p in TRAJECTORY.split(', '))}>",
    "actions": f"struct<{', '.join(p.replace(' ', ':', 1) for p in ACTIONS.split(', '))}>",
    "observations": f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in OBSERVATION.split(', '))}>>",
}
_PLACE = r"/([^/]+)/([^/]+)/([a-z]+)\.json$"


def folder_names(tasks: list[str] | None) -> list[str]:
    """The folder names, old ones included, of the named tasks; every folder without a list."""
    if tasks is None:
        return ["*"]
    wanted = {dims.TASK_IDS_BY_ANY_NAME[t] for t in tasks}
    return sorted(name for name, number in dims.TASK_IDS_BY_ANY_NAME.items() if number in wanted)


def _files(spark: SparkSession, root: str, tasks: list[str] | None) -> DataFrame | None:
    """(folder, index, kind, content) of every file, only the wanted tasks' folders being listed."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    globs = []
    for name in folder_names(tasks):
        pattern = f"{root.rstrip('/')}/{name}/*/*.json"
        if fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")):
            globs.append(pattern)
    if not globs:
        return None
    try:
        rows = spark.read.option("wholetext", "true").text(globs)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    place = lambda n: F.regexp_extract("file", _PLACE, n)
    return rows.select(F.input_file_name().alias("file"), F.col("value").alias("content")).select(
        F.url_decode(place(1)).alias("folder"), place(2).alias("index"), place(3).alias("kind"), "content"
    )


def _zipped(actions: Column) -> Column:
    """Parallel arrays of poses as an array of indexed structs; NULL when their lengths differ."""
    names = ["pose0_position", "pose0_rotation", "pose1_position", "pose1_rotation"]
    first = F.size(actions[names[0]])
    equal = F.lit(True)
    for name in names[1:]:
        equal = equal & (F.size(actions[name]) == first)
    whole = F.forall(actions["pose0_position"], lambda p: F.size(p) == 3) & F.forall(
        actions["pose0_rotation"], lambda p: F.size(p) == 4
    )
    records = F.transform(
        actions[names[0]],
        lambda _, i: F.struct(i.cast("bigint").alias("index"), *[F.get(actions[n], i).alias(n) for n in names]),
    )
    return F.when(equal & whole, records)


def read_raw_episodes(spark: SparkSession, root: str, tasks: list[str] | None = None) -> DataFrame:
    """One row per episode folder, with ``task`` (name and old names as one number), idx and ``status``.

    ``tasks`` keeps the folders of other tasks from being listed at all.  ``status`` is ``ok``,
    ``unknown task``, ``bad index``, ``no trajectory`` (or actions, observations: the file is missing),
    ``broken trajectory`` (...: it cannot be parsed), ``uneven actions`` or ``observations and actions
    differ`` (an episode has as many of each, or one observation more).
    """
    files = _files(spark, root, tasks)
    if files is None:
        files = spark.createDataFrame([], "folder string, index string, kind string, content string")
    parsed = [F.from_json(F.when(F.col("kind") == k, F.col("content")), schema, {"mode": "PERMISSIVE"}).alias(k) for k, schema in _KINDS.items()]
    present = [(F.col("kind") == k).alias(f"has_{k}") for k in _KINDS]
    # parsed before the shuffle, so that the texts stay where they are read
    episodes = (
        files.select("folder", "index", *parsed, *present)
        .groupBy("folder", "index")
        .agg(
            *[F.first(k, ignorenulls=True).alias(k) for k in _KINDS],
            *[F.bool_or(f"has_{k}").alias(f"has_{k}") for k in _KINDS],
        )
        .withColumn("pose_actions", _zipped(F.col("actions")))
    )
    broken = {"trajectory": F.col("trajectory.prompt").isNull() | F.col("trajectory.success").isNull(),
              "actions": F.col("actions.pose0_position").isNull(), "observations": F.col("observations").isNull()}
    number = F.try_element_at(
        F.create_map(*[F.lit(x) for item in dims.TASK_IDS_BY_ANY_NAME.items() for x in item]), F.col("folder")
    )
    more = F.size("observations") - F.size("pose_actions")
    status = F.when(number.isNull(), F.lit("unknown task")).when(~F.col("index").rlike("^[0-9]{1,18}$"), F.lit("bad index"))
    for kind in _KINDS:
        status = status.when(~F.col(f"has_{kind}"), F.lit(f"no {kind}"))
    for kind, fault in broken.items():
        status = status.when(fault, F.lit(f"broken {kind}"))
    status = (
        status.when(F.col("pose_actions").isNull(), F.lit("uneven actions"))
        .when(~more.isin(0, 1), F.lit("observations and actions differ"))
        .otherwise(F.lit("ok"))
    )
    objects = F.transform(
        F.map_entries("trajectory.obj_id_to_info"),
        lambda e: F.struct(
            e["key"].try_cast("bigint").alias("obj_id"),
            e["value"]["obj_name"].alias("obj_name"),
            e["value"]["obj_assets"].alias("obj_asset_name"),
            e["value"]["texture_name"].alias("texture_name"),
        ),
    )
    return episodes.select(
        "folder",
        F.col("index").alias("name"),
        number.alias("task"),
        F.expr("try_cast(`index` AS bigint)").alias("idx"),
        status.alias("status"),
        F.col("trajectory.steps").alias("total_steps"),
        F.col("trajectory.success").alias("is_successful_at_end"),
        F.col("trajectory.seed").alias("generation_seed"),
        F.col("trajectory.end_effector_type").alias("end_effector_type"),
        F.col("trajectory.prompt").alias("prompt"),
        F.col("trajectory.prompt_assets").alias("prompt_assets"),
        objects.alias("object_metadata"),
        "pose_actions",
        F.array_sort("observations").alias("observations"),
    )
