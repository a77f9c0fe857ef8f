"""Sources, sinks, dataset building and splitting bound to the given tables (S, L1-L6, W10, P1-P6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodium import dims
from episodium.functions.arrays import lists_to_records
from episodium.functions.keyed import sql_hash
from episodium.operators import datasets as ds
from episodium.operators.assets import object_metadata
from episodium.plans import bindings as b
from episodium.plans.registry import query
from episodium.sources import tables as io
from episodium.sources.shards import publish_shards, read_shards
from episodium.workspace import new_folder, settle

ALIASES = {}
for _name, _id in dims.TASK_IDS_BY_ANY_NAME.items():
    ALIASES.setdefault(_id, []).append(_name)
WANTED_TASKS = ["visual_manipulation", "sweep_without_exceeding"]
WANTED_NAMES = [n for t in WANTED_TASKS for n in ALIASES[dims.TASKS[t]]]
QUOTED_NAMES = ", ".join(b.sql_text(n) for n in WANTED_NAMES)


def digest_sql(*columns: str) -> str:
    """:func:`row_digest` as SQL text."""
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT"


def fingerprint_sql(*columns: str) -> str:
    """The fingerprint of a shard manifest as SQL text."""
    return f"CAST(sum({digest_sql(*columns)}) % {io.FINGERPRINT_PRIME} AS BIGINT)"


@query(
    "s1_list_episodes",
    f"""WITH {b.INSTANCES} SELECT idx, task_name || '/' || printf('%06d', idx) AS path
    FROM instances WHERE task_name IN ({QUOTED_NAMES})""",
)
def s1(spark, folder):
    return io.list_episodes(b.instances(spark, folder), WANTED_TASKS).select("idx", "path")


@query(
    "s2_parse_episodes",
    f"""WITH {b.STEPS}, {b.INSTANCES}, acted AS (SELECT idx, count(*) AS n_actions, count(*) FILTER (qty > 1) AS n_obs,
      string_agg(CAST(part AS VARCHAR), ',' ORDER BY t) AS parts FROM steps GROUP BY idx)
    SELECT i.idx, coalesce(n_actions, 0) AS n_actions, coalesce(n_obs, 0) AS n_obs,
      CASE WHEN coalesce(n_actions, 0) = coalesce(n_obs, 0) THEN 'ok' ELSE 'reject' END AS status,
      CASE WHEN coalesce(n_actions, 0) = coalesce(n_obs, 0) THEN coalesce(parts, '') END AS parts
    FROM instances i LEFT JOIN acted USING (idx)""",
)
def s2(spark, folder):
    steps = b.steps(spark, folder)
    parsed = ds.parse_episodes(
        b.instances(spark, folder).select("idx"), steps, steps.where(F.col("qty") > 1), ["part", "qty"]
    )
    parts = F.array_join(F.transform("actions", lambda a: a["part"].cast("string")), ",")
    return parsed.select("idx", "n_actions", "n_obs", "status", parts.alias("parts"))


@query(
    "s3_object_metadata",
    f"""WITH {b.PARTS} SELECT part AS idx, part AS obj_id, noun AS obj_name, brand AS obj_asset_name, texture AS texture_name FROM parts
    UNION ALL SELECT part, -1 - part, kind, brand, texture FROM parts""",
)
def s3(spark, folder):
    info = lambda name: F.struct(F.col(name).alias("obj_name"), "brand", "texture")
    with_map = b.parts(spark, folder).select(
        "part",
        F.create_map(F.col("part"), info("noun"), -1 - F.col("part"), info("kind")).alias("objects"),
    )
    as_list = object_metadata(F.col("objects"))
    return with_map.select(F.col("part").alias("idx"), F.explode(as_list).alias("o")).select("idx", "o.*")


@query(
    "s4_indexed_actions",
    f"WITH {b.STEPS} SELECT idx, t AS position, part, qty FROM steps",
)
def s4(spark, folder):
    nested = ds.nest(b.steps(spark, folder), ["idx"], ["part", "qty"], "actions")
    arrays = nested.select(
        "idx", F.col("actions.part").alias("parts"), F.col("actions.qty").alias("qtys")
    )
    records = lists_to_records(part=F.col("parts"), qty=F.col("qtys"))
    return arrays.select("idx", F.posexplode(records).alias("i", "a")).select(
        "idx",
        F.col("i").cast("bigint").alias("position"),
        "a.part",
        "a.qty",
    )


@query(
    "s5_null_action",
    f"""WITH {b.poses_sql()}, {b.INSTANCES}, n AS (SELECT idx, count(*) AS n FROM steps GROUP BY idx)
    SELECT i.idx, coalesce(n, 0) AS n_obs_plain, coalesce(n, 0) + 1 AS n_actions_kept, 0.32e0 AS last_z
    FROM instances i LEFT JOIN n USING (idx)""",
)
def s5(spark, folder):
    headers = b.instances(spark, folder).select("idx")
    poses = settle(b.poses(spark, folder).select("idx", "t", "p0x", "p0y", "p0z"), "poses")
    start = dict(zip(["p0x", "p0y", "p0z"], dims.START_POSITION, strict=True))
    kept = ds.append_null_action(headers, poses, start)
    plain = ds.truncate_observations(kept, poses)  # one observation more than actions
    return (
        kept.groupBy("idx")
        .agg(F.count(F.lit(1)).alias("n_actions_kept"), F.max_by("p0z", "t").alias("last_z"))
        .join(plain.groupBy("idx").agg(F.count(F.lit(1)).alias("n")), "idx", "left")
        .select("idx", F.coalesce("n", F.lit(0)).alias("n_obs_plain"), "n_actions_kept", "last_z")
    )


def tracker_sql(last: int) -> str:
    return f"""WITH {b.OUTCOMES}, counted AS (SELECT *, count(*) OVER (PARTITION BY idx) AS n FROM steps)
    SELECT c.idx, c.t, o.is_successful_at_end AND c.t >= c.n - {last} AS success
    FROM counted c JOIN outcomes o USING (idx)"""


@query("s6_success_tracker", tracker_sql(1))
def s6(spark, folder):
    return ds.demonstration_tracker(
        b.steps(spark, folder), b.outcomes(spark, folder).select("idx", "is_successful_at_end"), False
    )


@query("s6_success_tracker_null_action", tracker_sql(2))
def s6_null(spark, folder):
    return ds.demonstration_tracker(
        b.steps(spark, folder), b.outcomes(spark, folder).select("idx", "is_successful_at_end"), True
    )


INGEST_SQL = f"""WITH {b.INSTANCES} SELECT partition, count(*) AS n, count(DISTINCT idx) AS n_keys,
  CAST(sum(%s) AS BIGINT) AS seeds FROM instances GROUP BY partition"""


@query("s7_idempotent_ingest", INGEST_SQL % "seed")
def s7(spark, folder):
    rows = b.instances(spark, folder).select("idx", "partition", "seed")
    path = new_folder(spark, "ingest")
    io.ingest(rows.where(F.col("partition") == 1), path, ["idx"])
    io.ingest(rows, path, ["idx"])  # adds what is missing
    io.ingest(rows, path, ["idx"])  # adds nothing
    return spark.read.parquet(path).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("n_keys"), F.sum("seed").alias("seeds")
    )


@query(
    "s7_replacing_ingest",
    INGEST_SQL % "CASE WHEN partition = 1 THEN seed + 7 ELSE seed END",
)
def s7_replace(spark, folder):
    rows = b.instances(spark, folder).select("idx", "partition", "seed")
    path = io.ingest(rows, new_folder(spark, "ingest"), ["idx"])
    changed = rows.where(F.col("partition") == 1).withColumn("seed", F.col("seed") + 7)
    merged = io.ingest(changed, path, ["idx"], replaced_path=new_folder(spark, "ingest"))
    return spark.read.parquet(merged).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("n_keys"), F.sum("seed").alias("seeds")
    )


@query(
    "s7_replaced_partitions",
    """WITH i AS (SELECT o_orderkey AS idx, o_orderkey % 8 AS bucket, o_custkey AS seed, o_orderkey % 8 IN (1, 5) AND o_orderkey % 3 = 0 AS changed FROM orders)
    SELECT bucket, count(*) AS n, CAST(sum(CASE WHEN changed THEN seed + 7 ELSE seed END) AS BIGINT) AS seeds FROM i GROUP BY bucket""",
)
def s7_partitions(spark, folder):
    rows = b.instances(spark, folder).select("idx", (F.col("idx") % 8).alias("bucket"), "seed")
    path = new_folder(spark, "replaced")
    io.replace_rows(rows, path, ["idx"], ["bucket"])
    changed = rows.where("bucket IN (1, 5) AND idx % 3 = 0").withColumn("seed", F.col("seed") + 7)
    io.replace_rows(changed, path, ["idx"], ["bucket"])  # the other buckets are not written again
    return spark.read.parquet(path).groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("seed").alias("seeds")
    )


VALID_TOTAL = 600
SPLIT = f"""{b.INSTANCES}, sizes AS (SELECT task, count(*) AS n, sum(count(*)) OVER () AS total FROM instances GROUP BY task),
quotas AS (SELECT task, n, CAST(floor({VALID_TOTAL} * (CAST(n AS DOUBLE) / CAST(total AS DOUBLE))) AS BIGINT) AS quota FROM sizes),
split AS (SELECT i.*, CASE WHEN row_number() OVER (PARTITION BY i.task ORDER BY {sql_hash("split-1", "i.idx")}, i.idx) <= quota
  THEN 'valid' ELSE 'train' END AS split FROM instances i JOIN quotas USING (task))"""


def split_instances(spark, folder):
    return ds.stratified_split(b.instances(spark, folder), VALID_TOTAL, "split-1")


def typed_table(spark, folder):
    """The split instances as a typed table on storage."""
    path = new_folder(spark, "typed")
    io.write_typed(
        split_instances(spark, folder).select("idx", "partition", "seed", "task", "split"),
        path,
        ["task", "split"],
    )
    return io.read_typed(spark, path)


@query(
    "s8_typed_dataset",
    f"""WITH {SPLIT} SELECT task, split, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum,
      CAST(sum(seed) AS BIGINT) AS seed_sum FROM split GROUP BY task, split""",
)
def s8(spark, folder):
    return typed_table(spark, folder).groupBy("task", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"), F.sum("seed").alias("seed_sum")
    )


SHARDED = f"""{SPLIT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY idx) - 1 AS i,
    count(*) OVER (PARTITION BY split) AS total, CASE split WHEN 'train' THEN 20 ELSE 5 END AS shards FROM split),
sharded AS (SELECT *, CASE WHEN i < (total % shards) * (total // shards + 1) THEN i // (total // shards + 1)
    ELSE total % shards + (i - (total % shards) * (total // shards + 1)) // greatest(total // shards, 1) END AS shard
  FROM numbered)"""


@query(
    "s9_sharded_files",
    f"""WITH {SHARDED} SELECT split, shard, count(*) AS n_rows, min(idx) AS first_idx, max(idx) AS last_idx,
      printf('%s-%05d-of-%05d-%d', split, shard, any_value(shards), {fingerprint_sql("idx", "task", "seed")}) AS file
    FROM sharded GROUP BY split, shard""",
)
def s9(spark, folder):
    rows = split_instances(spark, folder).select("idx", "task", "seed", "split")
    sharded = io.assign_shards(rows, "split", "idx", dims.SHARDS_PER_SPLIT)
    path = new_folder(spark, "shards")
    io.write_shards(sharded, path)
    stored = spark.read.parquet(path)
    manifest = io.shard_manifest(stored, io.row_digest("idx", "task", "seed"), ["split", "shard"])
    bounds = stored.groupBy("split", "shard").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )
    shards = b.lookup(dims.SHARDS_PER_SPLIT, F.col("split"))
    name = io.shard_name(F.col("split"), F.col("shard"), shards, F.col("fingerprint"))
    return manifest.join(bounds, ["split", "shard"]).select(
        "split", F.col("shard").cast("bigint").alias("shard"), "n_rows", "first_idx", "last_idx", name.alias("file")
    )


OLD_MANIFEST = "task <> 5"
NEW_MANIFEST = "task <> 2"
NEW_SEED = "CASE WHEN price > 480000 THEN seed + 1 ELSE seed END"


@query(
    "s10_shard_decisions",
    f"""WITH {b.INSTANCES}, old AS (SELECT task, idx // 1000 AS shard, (count(*), {fingerprint_sql("idx", "seed")}) AS f
      FROM instances WHERE {OLD_MANIFEST} GROUP BY ALL),
    new AS (SELECT task, idx // 1000 AS shard, (count(*), {fingerprint_sql("idx", f"({NEW_SEED})")}) AS f
      FROM instances WHERE {NEW_MANIFEST} GROUP BY ALL)
    SELECT task, shard, CASE WHEN new.f IS NULL THEN 'drop' WHEN old.f IS NULL THEN 'write'
      WHEN new.f = old.f THEN 'skip' ELSE 'rewrite' END AS decision
    FROM old FULL JOIN new USING (task, shard)""",
)
def s10(spark, folder):
    rows = b.instances(spark, folder).withColumn("shard", F.floor(F.col("idx") / 1000))
    by = ["task", "shard"]
    digest = io.row_digest("idx", "seed")
    old = io.shard_manifest(rows.where(OLD_MANIFEST), digest, by)
    new = io.shard_manifest(
        rows.where(NEW_MANIFEST).withColumn("seed", F.expr(NEW_SEED)), digest, by
    )
    return io.shard_decisions(old, new, by)


CHANGED_SEED = "CASE WHEN idx < 100 THEN seed + 1 ELSE seed END"


@query(
    "s10_published_shards",
    f"""WITH {SHARDED}, f AS (SELECT split, shard, any_value(shards) AS shards, count(*) AS n_rows,
      {fingerprint_sql("idx", "task", "seed")} AS old, {fingerprint_sql("idx", "task", f"({CHANGED_SEED})")} AS new,
      CAST(sum({CHANGED_SEED}) AS BIGINT) AS seeds FROM sharded GROUP BY split, shard)
    SELECT split, shard, CASE WHEN old = new THEN 'skip' ELSE 'rewrite' END AS decision, n_rows, seeds,
      printf('%s-%05d-of-%05d-%d.parquet', split, shard, shards, new) AS file FROM f""",
)
def s10_published(spark, folder):
    # read four times: each publication takes fingerprints of the rows and then writes those that changed
    rows = settle(split_instances(spark, folder).select("idx", "task", "seed", "split"), "split")
    path, digest = new_folder(spark, "published"), ["idx", "task", "seed"]
    publish_shards(rows, path, "idx", dims.SHARDS_PER_SPLIT, digest)
    changed = rows.withColumn("seed", F.expr(CHANGED_SEED))
    done = publish_shards(changed, path, "idx", dims.SHARDS_PER_SPLIT, digest)
    stored = read_shards(spark, path).withColumn("file", F.substring_index(F.input_file_name(), "/", -1))
    sums = stored.groupBy("split", "file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("seed").alias("seeds"))
    return done.join(sums, ["split", "file"], "left").select("split", "shard", "decision", "n_rows", "seeds", "file")


@query(
    "s11_load_all_splits",
    f"""WITH {SPLIT} SELECT split, task, count(*) AS n, count(seed) AS n_seeds FROM (
      SELECT split, task, seed FROM split WHERE split = 'train'
      UNION ALL SELECT split, task, NULL FROM split WHERE split = 'valid') GROUP BY split, task""",
)
def s11(spark, folder):
    rows = split_instances(spark, folder)
    root = new_folder(spark, "splits")
    # the older layout of the validation files has no seed column
    rows.where("split = 'train'").select("idx", "task", "seed").write.parquet(f"{root}/a/train-set")
    rows.where("split = 'valid'").select("idx", "task").write.parquet(f"{root}/b/valid-set")
    loaded = ds.diagonal_concat(
        [io.read_split_folders(spark, f"{root}/a"), io.read_split_folders(spark, f"{root}/b")]
    )
    return loaded.groupBy("split", "task").agg(
        F.count(F.lit(1)).alias("n"), F.count("seed").alias("n_seeds")
    )


@query(
    "s12_config_names",
    f"""WITH {b.INSTANCES} SELECT partition_name || '/parsed--' || task_name AS config, count(*) AS n
    FROM instances GROUP BY ALL""",
)
def s12(spark, folder):
    name = io.config_name(F.col("partition_name"), F.lit("parsed"), F.col("task_name"))
    return b.instances(spark, folder).groupBy(name.alias("config")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s13_pruned_task_read",
    f"WITH {SPLIT} SELECT idx, seed, split FROM split WHERE task IN (2, 16)",
)
def s13(spark, folder):
    return typed_table(spark, folder).where(F.col("task").isin(2, 16)).select("idx", "seed", "split")


METADATA = f"""{b.poses_sql()}, {b.INSTANCES}, {b.PARTS},
moves AS (SELECT idx, count(*) AS num_actions, arg_min(p0x, t) AS start_x, arg_min(r0z, t) AS start_rz,
  arg_max(p1y, t) AS end_y, arg_max(r1w, t) AS end_rw FROM poses GROUP BY idx),
scene AS (SELECT idx, count(DISTINCT part) AS num_objects, string_agg(DISTINCT noun, ',' ORDER BY noun) AS shapes,
  string_agg(DISTINCT texture, ',' ORDER BY texture) AS textures,
  string_agg(DISTINCT description, ',' ORDER BY description) AS object_types
  FROM steps JOIN parts USING (part) GROUP BY idx),
metadata AS (SELECT i.idx, i.partition, i.task, {b.sql_lookup(dims.GROUP_OF_TASK, "i.task")} AS task_group, i.seed,
  coalesce(num_actions, 0) AS num_actions, coalesce(num_objects, 0) AS num_objects,
  coalesce(shapes, '') AS shapes, coalesce(textures, '') AS textures, coalesce(object_types, '') AS object_types,
  start_x, start_rz, end_y, end_rw
  FROM instances i LEFT JOIN moves USING (idx) LEFT JOIN scene USING (idx))"""


def scene_objects(spark, folder):
    """One row per (episode, step) with the step's object."""
    items = b.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("part")
    )
    return items.join(b.parts(spark, folder), "part")


def metadata(spark, folder):
    headers = b.instances(spark, folder).select("idx", "partition", "task", "seed")
    return ds.instance_metadata(headers, b.poses(spark, folder), scene_objects(spark, folder))


@query("p1_instance_metadata", f"WITH {METADATA} SELECT * FROM metadata")
def p1(spark, folder):
    flat = metadata(spark, folder)
    return flat.select(
        "idx", "partition", "task", "task_group", "seed", "num_actions", "num_objects",
        *[F.array_join(c, ",").alias(c) for c in ("shapes", "textures", "object_types")],
        F.col("first.p0x").alias("start_x"), F.col("first.r0z").alias("start_rz"),
        F.col("last.p1y").alias("end_y"), F.col("last.r1w").alias("end_rw"),
    )


METADATA_SCHEMA = (
    "idx bigint, partition int, task int, seed bigint, task_group int, num_actions bigint, num_objects bigint, "
    "shapes array<string>, textures array<string>, object_types array<string>, "
    "first struct<p0x:double,p0y:double,p0z:double,r0x:double,r0y:double,r0z:double,r0w:double>, "
    "last struct<p1x:double,p1y:double,p1z:double,r1x:double,r1y:double,r1z:double,r1w:double>"
)


def metadata_dump(spark, folder):
    """Path of the metadata as JSON lines, one folder per split."""
    split = split_instances(spark, folder).select("idx", "split")
    path = new_folder(spark, "metadata")
    io.write_json_lines(metadata(spark, folder).join(split, "idx"), path)
    return path


@query(
    "s14_metadata_dump",
    f"""WITH {SPLIT}, {METADATA.replace(b.INSTANCES + ",", "")}
    SELECT split, count(*) AS n, CAST(sum(num_actions) AS BIGINT) AS actions, CAST(sum(num_objects) AS BIGINT) AS objects
    FROM metadata JOIN split USING (idx) GROUP BY split""",
)
def s14(spark, folder):
    stored = spark.read.schema(METADATA_SCHEMA + ", split string").json(metadata_dump(spark, folder))
    return stored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_actions").alias("actions"), F.sum("num_objects").alias("objects")
    )


@query(
    "s15_scan_json_lines",
    f"""WITH {METADATA} SELECT idx, task, task_group, num_actions, textures, start_x, end_y FROM metadata""",
)
def s15(spark, folder):
    stored = spark.read.schema(METADATA_SCHEMA).json(metadata_dump(spark, folder))
    return stored.select(
        "idx", "task", "task_group", "num_actions", F.array_join("textures", ",").alias("textures"),
        F.col("first.p0x").alias("start_x"), F.col("last.p1y").alias("end_y"),
    )


@query(
    "s16_column_major_json",
    f"""WITH {b.EPISODES} SELECT partition, task + 1 AS task, is_successful_at_end, time_limit, steps_taken,
      CASE WHEN is_successful_at_end THEN time_limit - steps_taken >= 0 ELSE false END AS strict FROM episodes""",
)
def s16(spark, folder):
    from episodium.operators.evaluation import with_strict_success

    episodes = b.episodes(spark, folder).select(
        "idx", "partition", "task", "is_successful_at_end",
        F.col("time_limit").alias("minimum_steps"), F.col("steps_taken").alias("total_steps"),
    )
    columns = ["partition", "task", "is_successful_at_end", "minimum_steps", "total_steps"]
    documents = io.column_major(episodes, columns, F.floor(F.col("idx") / 512))
    rows = io.parse_column_major(
        documents,
        {"partition": "int", "task": "int", "is_successful_at_end": "boolean", "minimum_steps": "bigint", "total_steps": "bigint"},
    )
    named = rows.select(
        "partition", (F.col("task") + 1).alias("task"), "is_successful_at_end",
        F.col("minimum_steps").alias("time_limit"), F.col("total_steps").alias("steps_taken"),
    )
    return with_strict_success(named)


CSV_COLUMNS = (
    "partition string, task string, is_successful_at_end boolean, steps_taken int, max_swept_obj int, "
    "num_dragged_obj int, num_base_obj int, num_target_base_obj int"
)


@query(
    "s17_result_csv",
    f"""WITH {b.EPISODES} SELECT partition, task + 1 AS task, is_successful_at_end, CAST(steps_taken AS INTEGER) AS steps_taken,
      time_limit, strict, time_limit IS NULL AS limit_missing FROM episodes""",
)
def s17(spark, folder):
    from episodium.operators.evaluation import with_strict_success, with_time_limit

    numbers = ["max_swept_obj", "num_dragged_obj", "num_base_obj", "num_target_base_obj"]
    old = b.outcomes(spark, folder).select(
        F.col("partition_name").alias("partition"), F.col("task_name").alias("task"),
        "is_successful_at_end", "steps_taken",
        *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in numbers],
    )
    path = new_folder(spark, "results")
    old.write.option("header", "true").csv(path)
    decoded = (
        io.read_result_csv(spark, path, CSV_COLUMNS)
        .withColumn("task", ds.decode_enum(F.col("task"), dims.TASK_IDS_BY_ANY_NAME))
        .withColumn("partition", ds.decode_enum(F.col("partition"), dims.PARTITIONS))
    )
    checked = decoded.transform(with_time_limit).transform(with_strict_success)
    return checked.select(
        "partition", (F.col("task") + 1).alias("task"), "is_successful_at_end", "steps_taken",
        "time_limit", "strict", F.col("time_limit").isNull().alias("limit_missing"),
    )


@query(
    "s18_rematerialise",
    f"""WITH {SPLIT}, {b.STEPS}, contents AS (SELECT idx, count(*) AS n_steps FROM steps GROUP BY idx),
    assignment AS (SELECT idx, split FROM split WHERE partition <> 3)
    SELECT idx, split, n_steps, CASE WHEN n_steps IS NULL THEN 'missing' WHEN split IS NULL THEN 'unassigned' ELSE 'kept' END AS status
    FROM assignment FULL JOIN contents USING (idx)""",
)
def s18(spark, folder):
    assignment = split_instances(spark, folder).where("partition <> 3").select("idx", "split")
    contents = (
        b.table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("idx"))
        .agg(F.count(F.lit(1)).alias("n_steps"))
    )
    return ds.rematerialise(assignment, contents, ["idx"])


LISTING = """listing AS (SELECT page_id % 20 AS run,
  CASE WHEN page_id % 9 = 0 THEN 'last' ELSE printf('epoch=%02d', page_id // 20) END || '-' || page_id || '.ckpt' AS file
  FROM pages)"""


@query(
    "s19_checkpoint_for_epoch",
    f"""WITH {LISTING}, named AS (SELECT run, file, CAST(regexp_extract(file, 'epoch=([0-9]+)', 1) AS INTEGER) AS e
      FROM listing WHERE file LIKE 'epoch=%'),
    counts AS (SELECT run, count(*) AS files FROM named GROUP BY run),
    requests AS (SELECT DISTINCT run, epoch FROM listing, (VALUES (-1), (3), (999)) AS r(epoch)),
    asked AS (SELECT r.run, epoch, CASE WHEN epoch < 0 THEN coalesce(files, 0) - 1 ELSE epoch END AS wanted_epoch
      FROM requests r LEFT JOIN counts USING (run))
    SELECT a.run, a.epoch, a.wanted_epoch, min(file) AS file
    FROM asked a LEFT JOIN named n ON n.run = a.run AND n.e = a.wanted_epoch GROUP BY ALL""",
)
def s19(spark, folder):
    page = F.col("page_id")
    name = F.when(page % 9 == 0, F.lit("last")).otherwise(
        F.format_string("epoch=%02d", F.floor(page / 20))
    )
    listing = b.table(spark, folder, "pages").select(
        (page % 20).alias("run"), F.concat(name, F.lit("-"), page.cast("string"), F.lit(".ckpt")).alias("file")
    )
    asked = F.explode(F.array(F.lit(-1), F.lit(3), F.lit(999)))
    requests = listing.select("run").distinct().select("run", asked.alias("epoch"))
    return io.checkpoint_for_epoch(listing, requests)


@query(
    "s20_episode_sink",
    f"""WITH {b.OUTCOMES}, counts AS (SELECT idx, count(*) AS n, count(*) FILTER (qty > 1) AS seen FROM steps GROUP BY idx),
    checked AS (SELECT o.task, o.is_successful_at_end AS success, coalesce(n, 0) AS n,
      coalesce(seen, 0) + 1 = coalesce(n, 0) + 1 AS accepted FROM outcomes o LEFT JOIN counts USING (idx))
    SELECT task, count(*) FILTER (accepted) AS headers, CAST(coalesce(sum(n) FILTER (accepted), 0) AS BIGINT) AS steps,
      count(*) FILTER (accepted AND NOT success) AS failures, count(*) FILTER (NOT accepted) AS rejected
    FROM checked GROUP BY task""",
)
def s20(spark, folder):
    outcomes = b.outcomes(spark, folder).select("idx", "task", F.col("is_successful_at_end").alias("success"))
    steps = settle(b.steps(spark, folder).select("idx", "t", "part", "qty"), "steps")
    last = outcomes.select("idx", F.lit(-1).cast("bigint").alias("t"))
    seen = steps.where("qty > 1").select("idx", "t").unionByName(last)
    path = new_folder(spark, "episodes")
    checked = io.save_episodes(outcomes, steps, seen, path)
    stored = spark.read.parquet(path + "/headers").groupBy("task").agg(
        F.count(F.lit(1)).alias("headers"), F.count_if(F.col("failure")).alias("failures")
    )
    written = spark.read.parquet(path + "/steps").groupBy("task").agg(F.count(F.lit(1)).alias("steps"))
    rejected = checked.groupBy("task").agg(F.count_if(~F.col("accepted")).alias("rejected"))
    return stored.join(written, "task").join(rejected, "task").select(
        "task", "headers", "steps", "failures", "rejected"
    )


# --- counters, ranges, splits and batches --------------------------------------------------------


@query(
    "p2_value_counters",
    f"""WITH {b.PARTS}, objects AS (SELECT l_orderkey AS idx, p.* FROM lineitem JOIN parts p ON part = l_partkey)
    SELECT idx, kind, value, count(*) AS n FROM (
      SELECT idx, 'shape' AS kind, noun AS value FROM objects UNION ALL
      SELECT idx, 'texture', texture FROM objects UNION ALL SELECT idx, 'object', description FROM objects) GROUP BY ALL""",
)
def p2(spark, folder):
    return ds.value_counters(
        scene_objects(spark, folder), {"shape": "noun", "texture": "texture", "object": "description"}
    )


@query(
    "p5_filtered_set",
    f"WITH {b.INSTANCES} SELECT idx, partition, task FROM instances WHERE partition IN (1, 3) AND task IN (0, 11)",
)
def p5(spark, folder):
    return ds.evaluation_filter(b.instances(spark, folder), [1, 3], [0, 11]).select("idx", "partition", "task")


@query(
    "p6_index_range",
    """WITH numbered AS (SELECT o_orderkey AS idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders
      WHERE o_orderstatus <> 'P') SELECT * FROM numbered WHERE i >= 500 AND i < 9000""",
)
def p6(spark, folder):
    rows = (
        b.table(spark, folder, "orders")
        .where("o_orderstatus <> 'P'")
        .select(F.col("o_orderkey").alias("idx"))
    )
    return ds.index_range(rows, "idx", 500, 9000)


@query("l1_validation_quota", f"WITH {SPLIT} SELECT task, n, quota FROM quotas")
def l1(spark, folder):
    return ds.validation_quota(b.instances(spark, folder), VALID_TOTAL)


@query("l2_stratified_split", f"WITH {SPLIT} SELECT idx, task, split FROM split")
def l2(spark, folder):
    return split_instances(spark, folder).select("idx", "task", "split")


WORLD = 7


@query(
    "l3_rank_share",
    f"""WITH n AS (SELECT o_orderkey AS idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders),
    e AS (SELECT *, total // {WORLD} AS small, total % {WORLD} AS extra FROM n)
    SELECT idx, CASE WHEN i < extra * (small + 1) THEN i // (small + 1) ELSE extra + (i - extra * (small + 1)) // small END AS rank
    FROM e""",
)
def l3(spark, folder):
    rows = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("idx"))
    return ds.rank_share(rows, "idx", WORLD)


BATCH = 32
BATCHES = f"""shuffled AS (SELECT o_orderkey AS idx, row_number() OVER (ORDER BY {sql_hash("epoch-1", "o_orderkey")}, o_orderkey) - 1 AS i,
  count(*) OVER () AS total FROM orders),
batches AS (SELECT idx, i // {BATCH} AS batch, i % {BATCH} AS slot FROM shuffled WHERE i < total // {BATCH} * {BATCH})"""


def batches(spark, folder):
    rows = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("idx"))
    return ds.shuffled_batches(rows, "idx", BATCH, "epoch-1")


@query("l5_batches", f"WITH {BATCHES} SELECT * FROM batches")
def l5(spark, folder):
    return batches(spark, folder)


@query(
    "l5_length_sorted_batches",
    """WITH n AS (SELECT l_orderkey AS idx, count(*) AS n_steps FROM lineitem GROUP BY l_orderkey),
    i AS (SELECT *, row_number() OVER (ORDER BY n_steps, idx) - 1 AS i FROM n) SELECT idx, n_steps, i // 32 AS batch, i % 32 AS slot FROM i""",
)
def l5_sorted(spark, folder):
    items = b.table(spark, folder, "lineitem")
    lengths = items.groupBy(F.col("l_orderkey").alias("idx")).agg(F.count(F.lit(1)).alias("n_steps"))
    return ds.length_sorted_batches(lengths, "idx", "n_steps", 32)


@query(
    "l6_diagonal_concat",
    """SELECT 'customer' AS source, c_custkey AS key, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS amount FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier
    UNION ALL SELECT 'part', p_partkey, NULL, p_type, CAST(p_size AS DOUBLE) FROM part""",
)
def l6(spark, folder):
    customers = b.table(spark, folder, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("key"),
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("amount"),
    )
    suppliers = b.table(spark, folder, "supplier").select(
        F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"),
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("amount"),
    )
    parts = b.table(spark, folder, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").cast("int").alias("key"),
        F.col("p_type").alias("segment"), F.col("p_size").alias("amount"),
    )
    return ds.diagonal_concat([customers, suppliers, parts])


@query(
    "w10_sorted_steps",
    f"""WITH {b.STEPS} SELECT idx,
      string_agg(CAST(part AS VARCHAR), ',' ORDER BY supp % 3, t) AS parts FROM steps GROUP BY ALL""",
)
def w10(spark, folder):
    steps = b.steps(spark, folder).withColumn("key", F.col("supp") % 3)
    nested = ds.nest(steps, ["idx"], ["key", "part"], "items")
    ordered = ds.sort_records(F.col("items"), "key")
    return nested.select(
        "idx", F.array_join(F.transform(ordered, lambda s: s["part"].cast("string")), ",").alias("parts")
    )
