"""Objects, poses, goals and pixels bound to the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from episodium import dims
from episodium.functions import pose as P
from episodium.functions.arrays import lists_to_records, records_to_list
from episodium.functions.joins import large
from episodium.functions.keyed import sql_hash
from episodium.operators import datasets as ds
from episodium.operators import assets as at
from episodium.operators import goals as go
from episodium.operators import scene as sc
from episodium.operators import sequences as sq
from episodium.operators.crops import object_crops
from episodium.operators.preprocess import end_effector_code
from episodium.plans import bindings as b
from episodium.plans.registry import query
from episodium.workspace import settle

# --- values, maps and records ----------------------------------------------------------------------

SEGMENTS = """segments AS (SELECT l_orderkey AS idx, l_linenumber AS line, unnest([0, 1, l_partkey % 7, l_suppkey % 5, l_linenumber]) AS id
  FROM lineitem)"""


def segments(spark, folder):
    """Per step the ids seen in the front and the top view."""
    items = b.table(spark, folder, "lineitem")
    number = lambda e: e.cast("bigint")
    return items.select(
        F.col("l_orderkey").alias("idx"),
        F.array(*[number(x) for x in (F.lit(0), F.lit(1), F.col("l_partkey") % 7, F.col("l_suppkey") % 5)]).alias("front"),
        F.array(*[number(x) for x in (F.col("l_partkey") % 7, F.col("l_linenumber"), F.lit(1))]).alias("top"),
    )


@query(
    "p8_object_ids",
    f"""WITH {SEGMENTS} SELECT idx, count(DISTINCT id) AS n_ids, CAST(sum(DISTINCT id) AS BIGINT) AS id_sum
    FROM segments WHERE id NOT IN (0, 1) GROUP BY idx""",
)
def p8(spark, folder):
    ids = segments(spark, folder).select(
        "idx", F.explode(sc.object_ids(F.col("front"), F.col("top"))).alias("id")
    )
    return ids.distinct().groupBy("idx").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("id").alias("id_sum"))


@query(
    "p9_placeholder_class",
    f"""WITH {b.PARTS}, asset AS (SELECT l_orderkey AS idx, count(DISTINCT l_partkey) AS n, min(description) AS d
      FROM lineitem JOIN parts ON part = l_partkey GROUP BY l_orderkey)
    SELECT idx, n AS descriptions, CASE WHEN n = 1 THEN 'object' ELSE 'scene' END AS kind,
      CASE WHEN n = 1 THEN d END AS description FROM asset""",
)
def p9(spark, folder):
    from episodium.plans.dataset_queries import scene_objects

    return at.placeholder_class(scene_objects(spark, folder), "idx", "part", "description")


@query(
    "p10_asset_lookup",
    f"""WITH {b.PARTS}, asked AS (SELECT *, CASE size % 3 WHEN 0 THEN 'base_obj' WHEN 1 THEN '{{dragged_obj}}' ELSE 'scene' END AS name FROM parts)
    SELECT part, name, CASE name WHEN 'base_obj' THEN description WHEN '{{dragged_obj}}' THEN brand END AS asset,
      name NOT IN ('base_obj', '{{dragged_obj}}') AS missing FROM asked""",
)
def p10(spark, folder):
    asked = b.parts(spark, folder).select(
        "part",
        F.create_map(F.lit("base_obj"), "description", F.lit("dragged_obj"), "brand").alias("assets"),
        F.when(F.col("size") % 3 == 0, "base_obj").when(F.col("size") % 3 == 1, "{dragged_obj}").otherwise("scene").alias("name"),
    )
    asset = at.asset_named(F.col("assets"), F.col("name"))
    return asked.select("part", "name", asset.alias("asset"), asset.isNull().alias("missing"))


@query(
    "p11_typed_assets",
    f"""WITH {b.PARTS} SELECT part, kind IN ('PROMO', 'SMALL') AS is_object,
      CASE WHEN kind IN ('PROMO', 'SMALL') THEN 1 ELSE 3 END AS descriptions,
      CASE WHEN kind IN ('PROMO', 'SMALL') THEN noun ELSE noun || ',' || noun || ' lid,' || noun || ' base' END AS names FROM parts""",
)
def p11(spark, folder):
    raw = F.struct(F.col("noun").alias("name"), F.col("texture").alias("texture"))
    with_suffix = lambda s: F.struct(F.concat("noun", F.lit(s)).alias("name"), F.col("texture").alias("texture"))
    is_object = F.col("kind").isin("PROMO", "SMALL")
    descriptions = F.when(is_object, F.array(raw)).otherwise(F.array(raw, with_suffix(" lid"), with_suffix(" base")))
    return b.parts(spark, folder).select("part", at.typed_asset(descriptions).alias("a")).select("part", "a.*")


@query(
    "p14_bbox_conversions",
    """WITH box AS (SELECT l_orderkey AS idx, l_partkey AS part, l_suppkey AS supp, l_linenumber * 3 AS x0, l_suppkey % 17 AS y0,
      CAST(l_quantity AS BIGINT) AS w, l_partkey % 23 AS h FROM lineitem)
    SELECT idx, part, supp, x0 + w AS x1, y0 + h AS y1, (x0 + x0 + w) // 2 AS xc, (y0 + y0 + h) // 2 AS yc, h, w FROM box""",
)
def p14(spark, folder):
    box = b.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        (F.col("l_linenumber") * 3).cast("bigint").alias("x0"), (F.col("l_suppkey") % 17).alias("y0"),
        F.col("l_quantity").cast("bigint").alias("w"), (F.col("l_partkey") % 23).alias("h"),
    )
    x0, y0 = F.col("x0"), F.col("y0")
    x1, y1 = at.corners(x0, y0, F.col("w"), F.col("h"))
    xc, yc = at.centre(x0, y0, x1, y1)
    return box.select("idx", "part", "supp", x1.alias("x1"), y1.alias("y1"), xc.alias("xc"), yc.alias("yc"), "h", "w")


@query(
    "p15_lists_and_records",
    """WITH lists AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lower(text), ' ') AS b2, turn % 5 = 4 AS longer FROM conversations)
    SELECT conv_id, turn, NOT longer AS equal_lengths, CASE WHEN NOT longer THEN len(a) END AS records,
      CASE WHEN NOT longer THEN a[1] || '/' || b2[1] END AS first_record,
      CASE WHEN NOT longer THEN array_to_string(b2, ' ') END AS back FROM lists""",
)
def p15(spark, folder):
    words, loud = F.split("text", " "), F.split(F.lower("text"), " ")
    lists = b.table(spark, folder, "conversations").select(
        "conv_id", "turn", words.alias("a"),
        F.when(F.col("turn") % 5 == 4, F.concat(loud, F.array(F.lit("extra")))).otherwise(loud).alias("b"),
    )
    records = lists_to_records(a=F.col("a"), b=F.col("b"))
    built = lists.withColumn("r", records)
    return built.select(
        "conv_id", "turn", F.col("r").isNotNull().alias("equal_lengths"),
        F.when(F.col("r").isNotNull(), F.size("r")).cast("bigint").alias("records"),
        F.concat(F.col("r")[0]["a"], F.lit("/"), F.col("r")[0]["b"]).alias("first_record"),
        F.array_join(records_to_list(F.col("r"), "b"), " ").alias("back"),
    )


@query(
    "p16_dot_list",
    """WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS k,
      CAST(user_id AS VARCHAR) AS u FROM events)
    SELECT event_id, 'kind' AS key, 'kind=' || event_type AS entry FROM e
    UNION ALL SELECT event_id, 'model.size', 'model.size=' || coalesce(k, 'null') FROM e
    UNION ALL SELECT event_id, 'model.owner.id', 'model.owner.id=' || u FROM e""",
)
def p16(spark, folder):
    size = F.from_json("props", "k bigint")["k"]
    nested = b.table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("kind"),
        F.struct(
            F.when(F.col("event_type") != "error", size).alias("size"),
            F.struct(F.col("user_id").alias("id")).alias("owner"),
        ).alias("model"),
    )
    return ds.dot_list(nested, ["event_id"])


@query(
    "p17_columns_by_glob",
    """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity, l_linestatus
    FROM lineitem""",
)
def p17(spark, folder):
    chosen = ds.select_matching(
        b.table(spark, folder, "lineitem"), ["l_*key", "l_line*", "*quantity", "l_ship*"], ["*date"]
    )
    return ds.cast_matching(chosen, {"*quantity": "string", "*number": "bigint"})


@query(
    "p18_on_table",
    f"""WITH {b.poses_sql()} SELECT idx, t, p0x * 1.2e0 BETWEEN 0.25 AND 0.75 AND p0y * 1.2e0 BETWEEN -0.5 AND 0.5 AS on_table FROM poses""",
)
def p18(spark, folder):
    return b.poses(spark, folder).select(
        "idx", "t", P.in_workspace(F.col("p0x") * 1.2, F.col("p0y") * 1.2).alias("on_table")
    )


@query(
    "p20_placeholder_records",
    f"""WITH {b.PARTS}, kinds AS (SELECT *, kind IN ('PROMO', 'SMALL', 'MEDIUM') AS is_object FROM parts)
    SELECT part, 'object' AS record, noun AS name, part AS obj_id, texture AS color, CAST(size AS DOUBLE) / 10 AS scaling, NULL AS color_value, 'difficulty,size' AS meta_keys FROM kinds WHERE is_object
    UNION ALL SELECT part, 'texture', texture, NULL, NULL, NULL, retail, 'difficulty,size' FROM kinds WHERE NOT is_object""",
)
def p20(spark, folder):
    meta = F.create_map(
        F.lit("difficulty"), F.lit("easy"), F.lit("sample_prob"), F.lit("0.5"), F.lit("size"), F.col("size").cast("string")
    )
    rows = b.parts(spark, folder).withColumn("meta", meta).withColumnRenamed("retail", "value")
    return at.placeholder_records(rows, F.col("kind").isin("PROMO", "SMALL", "MEDIUM"), "part")


@query(
    "p21_observation_tokens",
    f"""WITH {b.STEPS}, {b.INSTANCES}, seen AS (SELECT idx, line, count(*) FILTER (flag = 'R') AS front_objects, count(*) AS objects FROM steps GROUP BY ALL)
    SELECT idx, line, front_objects, objects, CASE WHEN task = 11 THEN 1 ELSE 0 END AS end_effector FROM seen JOIN instances USING (idx)""",
)
def p21(spark, folder):
    items = b.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "front").otherwise("top").alias("view"),
    )
    images = at.objects_by_view(items, ["idx", "line"], ["front"])
    effector = F.when(F.col("task") == 11, "spatula").otherwise("suction")
    effectors = b.instances(spark, folder).select("idx", end_effector_code(effector).alias("end_effector"))
    return images.join(effectors, "idx")


# --- catalogue joins -------------------------------------------------------------------------------

KNOWN_NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring"]


@query(
    "j4_catalogue_lookup",
    f"""WITH {b.PARTS} SELECT noun, count(*) AS n, noun IN ({', '.join(b.sql_text(n) for n in KNOWN_NOUNS)}) AS found FROM parts GROUP BY noun""",
)
def j4(spark, folder):
    names = spark.createDataFrame([(n,) for n in KNOWN_NOUNS], "noun string")
    checked = sc.missing_names(b.parts(spark, folder), names, "noun")
    return checked.groupBy("noun", "found").agg(F.count(F.lit(1)).alias("n"))


_DARK = "CASE WHEN size % 2 = 0 THEN 'dark ' ELSE '' END || texture"


@query(
    "j5_dark_pairs",
    f"""WITH {b.PARTS}, names AS (SELECT DISTINCT {_DARK} || ' ' || CAST(part % 40 AS VARCHAR) AS name FROM parts)
    SELECT l.name AS light, d.name AS dark FROM names l LEFT JOIN names d ON d.name = 'dark ' || l.name
    WHERE NOT starts_with(l.name, 'dark ')""",
)
def j5(spark, folder):
    name = F.concat(F.expr(_DARK), F.lit(" "), (F.col("part") % 40).cast("string"))
    return sc.dark_pairs(b.parts(spark, folder).select(name.alias("name")))


PALETTE = [tuple(v / 255 for v in rgb) for rgb in dims.SEGMENT_PALETTE]
POINTS = """points AS (SELECT vec_id, least(abs(CAST(embedding[1] AS DOUBLE)) * 4, 1.0e0) AS r,
  least(abs(CAST(embedding[2] AS DOUBLE)) * 4, 1.0e0) AS g, least(abs(CAST(embedding[3] AS DOUBLE)) * 4, 1.0e0) AS b FROM embeddings)"""


@query(
    "j6_nearest_colour",
    f"""WITH {POINTS}, {b.sql_values("palette", ["i", "pr", "pg", "pb"], [(i, *map(lambda v: f"{v!r}", rgb)) for i, rgb in enumerate(PALETTE)])},
    away AS (SELECT vec_id, i, sqrt((r - CAST(pr AS DOUBLE)) * (r - CAST(pr AS DOUBLE)) + (g - CAST(pg AS DOUBLE)) * (g - CAST(pg AS DOUBLE)) + (b - CAST(pb AS DOUBLE)) * (b - CAST(pb AS DOUBLE))) AS d FROM points, palette)
    SELECT vec_id, (list(i ORDER BY d, i))[1] AS nearest, (list(i ORDER BY d DESC, i))[1] AS farthest FROM away GROUP BY vec_id""",
)
def j6(spark, folder):
    channel = lambda i: F.least(F.abs(F.col("embedding")[i].cast("double")) * 4, F.lit(1.0))
    points = b.table(spark, folder, "embeddings").select(
        "vec_id", *[channel(i).alias(c) for i, c in enumerate("rgb")]
    )
    rgb = [F.col(c) for c in "rgb"]
    return points.select(
        "vec_id",
        sc.palette_extreme(rgb, PALETTE).alias("nearest"),
        sc.palette_extreme(rgb, PALETTE, farthest=True).alias("farthest"),
    )


# --- poses and goals ---------------------------------------------------------------------------

TARGETS_PER_EPISODE = 3
TARGET_X = "0.26e0 + ((seed * 7 + k * 13) % 50) / 100.0e0"
TARGET_Y = "((seed + k * 3) % 11) / 10.0e0 - 0.5e0"
TARGET_ANGLE = "((seed + k) % 8) * 0.7853981633974483e0"
OBJECT_ANGLE = "(supp % 16) * 0.39269908169872414e0"
OBJECT_SYMMETRY = "CASE supp % 3 WHEN 0 THEN 0.0e0 WHEN 1 THEN 1.5707963267948966e0 ELSE 6.283185307179586e0 END"


def targets(spark, folder):
    """Target poses of an episode, from its seed."""
    numbered = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.col("o_custkey").alias("seed"),
        F.explode(F.sequence(F.lit(0), F.lit(TARGETS_PER_EPISODE - 1))).alias("k"),
    )
    return numbered.select(
        "idx", "k", F.expr(TARGET_X).alias("x"), F.expr(TARGET_Y).alias("y"), F.expr(TARGET_ANGLE).alias("angle")
    )


def objects(spark, folder):
    """Object poses of an episode, from its steps."""
    return b.poses(spark, folder).select(
        "idx", "t", "flag", F.col("p0x").alias("x"), F.col("p0y").alias("y"),
        F.expr(OBJECT_ANGLE).alias("angle"), F.expr(OBJECT_SYMMETRY).alias("symmetry"), "p1x", "p1y",
    )


def match_sql(a: str, o: str, symmetry: str) -> str:
    """Two poses match, as SQL text."""
    raw = f"abs({a}.angle - {o}.angle)"
    folded = f"({raw} - floor({raw} / {symmetry}) * {symmetry})"
    error = f"CASE WHEN {symmetry} > 0 THEN least({folded}, {symmetry} - {folded}) ELSE 0.0e0 END"
    return (
        f"sqrt(({a}.x - {o}.x) * ({a}.x - {o}.x) + ({a}.y - {o}.y) * ({a}.y - {o}.y)) < 0.01 "
        f"AND {error} < {dims.ROTATION_TOLERANCE!r}"
    )


SCENE = f"""{b.poses_sql()}, targets AS (SELECT idx, k, {TARGET_X} AS x, {TARGET_Y} AS y, {TARGET_ANGLE} AS angle
  FROM (SELECT o_orderkey AS idx, o_custkey AS seed, unnest(range(0, {TARGETS_PER_EPISODE})) AS k FROM orders)),
objects AS (SELECT idx, t, flag, p0x AS x, p0y AS y, {OBJECT_ANGLE} AS angle, {OBJECT_SYMMETRY} AS symmetry, p1x, p1y, p0z AS z, part FROM poses),
pairs AS (SELECT o.idx, o.t, g.k FROM objects o JOIN targets g ON o.idx = g.idx AND {match_sql("o", "g", "o.symmetry")})"""


@query("j7_pose_matches", f"WITH {SCENE} SELECT idx, t, CAST(k AS INTEGER) AS k FROM pairs")
def j7(spark, folder):
    return sc.pose_matches(objects(spark, folder), targets(spark, folder), ["idx"]).select(
        "idx", "t", F.col("target_k").alias("k")
    )


@query(
    "j7_position_matches",
    f"""WITH {SCENE} SELECT o.idx, o.t, CAST(g.k AS INTEGER) AS k FROM objects o JOIN targets g ON o.idx = g.idx
      AND sqrt((o.x - g.x) * (o.x - g.x) + (o.y - g.y) * (o.y - g.y)) < 0.01""",
)
def j7_position(spark, folder):
    return sc.pose_matches(
        objects(spark, folder), targets(spark, folder), ["idx"], position_only=True
    ).select("idx", "t", F.col("target_k").alias("k"))


@query(
    "j8_overlapping_episodes",
    f"""WITH {b.poses_sql()}, sized AS (SELECT idx, flag, p0x AS x, p0y AS y, qty / 500.0e0 AS w, line / 70.0e0 AS h FROM poses)
    SELECT DISTINCT p.idx FROM sized p JOIN sized q ON p.idx = q.idx AND p.flag = 'R' AND q.flag = 'A'
      AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= greatest((p.w + q.w) / 2 + 0.01e0, (p.h + q.h) / 2 + 0.01e0)""",
)
def j8(spark, folder):
    sized = b.poses(spark, folder).select(
        "idx", "flag", F.col("p0x").alias("x"), F.col("p0y").alias("y"),
        (F.col("qty") / 500.0).alias("w"), (F.col("line") / 70.0).alias("h"),
    )
    first = sized.where("flag = 'R'").drop("flag")
    return sc.any_overlap(first, sized.where("flag = 'A'").drop("flag"), ["idx"])


@query(
    "j9_nearest_open_target",
    f"""WITH {SCENE}, takers AS (SELECT idx, k, min(t) AS t FROM pairs GROUP BY idx, k),
    waiting AS (SELECT * FROM objects o WHERE NOT EXISTS (SELECT 1 FROM takers x WHERE x.idx = o.idx AND x.t = o.t)),
    free AS (SELECT * FROM targets g WHERE NOT EXISTS (SELECT 1 FROM takers x WHERE x.idx = g.idx AND x.k = g.k)),
    away AS (SELECT w.idx, w.t, f.k, sqrt((w.x - f.x) * (w.x - f.x) + (w.y - f.y) * (w.y - f.y)) AS d FROM waiting w JOIN free f USING (idx)),
    best AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY idx, t ORDER BY d, k) = 1)
    SELECT idx, t, CAST(k AS INTEGER) AS k, d AS distance, row_number() OVER (PARTITION BY idx ORDER BY d DESC, t) - 1 AS rank FROM best""",
)
def j9(spark, folder):
    return go.nearest_open_target(settle(objects(spark, folder), "objects"), targets(spark, folder))


CONFLICTS = f"""{SCENE}, conflicts AS (
  SELECT d.idx FROM objects d JOIN targets g ON d.flag = 'A' AND d.idx = g.idx AND {match_sql("d", "g", "d.symmetry")}
  UNION SELECT o.idx FROM objects o JOIN objects d ON o.flag = 'R' AND d.flag = 'A' AND o.idx = d.idx AND {match_sql("o", "d", "o.symmetry")})"""


def conflicts(stored, target_poses):
    """Episodes in which an object with flag A gets in the way of targets or of objects with flag R."""
    return go.distractor_conflicts(
        stored.where("flag = 'A'"), target_poses, stored.where("flag = 'R'")
    )


@query("j10_distractor_conflicts", f"WITH {CONFLICTS} SELECT idx FROM conflicts")
def j10(spark, folder):
    return conflicts(settle(objects(spark, folder), "objects"), targets(spark, folder))


LISTED = [2, 3, 4, 5, 6]
DETECTED = f"""{b.PIXELS}, found AS (SELECT frame, id, (min(x) + max(x)) // 2 AS xc, (min(y) + max(y)) // 2 AS yc,
  max(y) - min(y) AS h, max(x) - min(x) AS w FROM pixels GROUP BY frame, id HAVING count(*) >= 2)"""
SLOTS = f"""{DETECTED}, slots AS (SELECT l.frame, l.id, coalesce(xc, 0) AS xc, coalesce(yc, 0) AS yc, coalesce(h, 0) AS h, coalesce(w, 0) AS w,
  xc IS NOT NULL AS mask FROM (SELECT vec_id AS frame, CAST(unnest({LISTED}) AS INTEGER) AS id FROM embeddings) l LEFT JOIN found f USING (frame, id))"""


def slots(spark, folder):
    found = sc.detections(b.pixels(spark, folder), ["frame"])
    return sc.fill_slots(b.frames(spark, folder).select("frame"), LISTED, found, ["frame"])


@query("j11_filled_slots", f"WITH {SLOTS} SELECT * FROM slots")
def j11(spark, folder):
    return slots(spark, folder).drop("place")


@query(
    "j12_task_parameters",
    f"""WITH {b.INSTANCES}, {b.sql_values("params", ["partition", "task", "difficulty"], [(p, t, p * 100 + t) for p, ts in dims.TASKS_PER_LEVEL.items() for t in ts])},
    asked AS (SELECT idx, task, CASE WHEN seed % 2 = 0 THEN 4 ELSE partition END AS partition FROM instances)
    SELECT a.idx, a.partition, a.task, difficulty, difficulty IS NULL AS missing
    FROM asked a LEFT JOIN params p ON p.partition = a.partition AND p.task = a.task""",
)
def j12(spark, folder):
    rows = [(p, t, p * 100 + t) for p, ts in dims.TASKS_PER_LEVEL.items() for t in ts]
    params = spark.createDataFrame(rows, "partition int, task int, difficulty int")
    asked = b.instances(spark, folder).select(
        "idx", "task", F.when(F.col("seed") % 2 == 0, F.lit(4)).otherwise(F.col("partition")).alias("partition")
    )
    return ds.task_parameters(asked, params, "difficulty")


ZONE_COLUMNS = {
    "zx": "0.3e0 + (seed % 5) / 12.5e0 + j * 0.05e0",
    "zy": "(seed % 7) / 10.0e0 - 0.3e0",
    "zz": "(seed % 3) * 0.05e0",
    "c": "CASE WHEN seed % 2 = 0 THEN 1.0e0 ELSE 0.6e0 END",
    "s": "CASE WHEN seed % 2 = 0 THEN 0.0e0 ELSE 0.8e0 END",
    "w": "0.4e0",
    "h": "0.7e0",
}
ZONES = f"""zones AS (SELECT idx, {", ".join(f"{e} AS {n}" for n, e in ZONE_COLUMNS.items())}
  FROM (SELECT o_orderkey AS idx, o_custkey AS seed, unnest([0, 1]) AS j FROM orders))"""
ZONE_TOP = 0.3


@query(
    "a15_zone_progress",
    f"""WITH {b.poses_sql()}, {ZONES},
    local AS (SELECT idx, c * (p0x - zx) + s * (p0y - zy) AS u, c * (p0y - zy) - s * (p0x - zx) AS v, p0z - zz AS z, w, h FROM poses JOIN zones USING (idx)),
    p AS (SELECT idx, count(*) FILTER (abs(u) < w / 2 AND abs(v) < h / 2 AND z < {ZONE_TOP}) / count(*) AS progress FROM local GROUP BY idx)
    SELECT idx, progress, abs(1 - progress) < 0.001 AS complete FROM p""",
)
def a15(spark, folder):
    base = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("seed"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j")
    )
    zones = base.select("idx", *[F.expr(e).alias(n) for n, e in ZONE_COLUMNS.items()])
    points = b.poses(spark, folder).select(
        "idx", F.col("p0x").alias("x"), F.col("p0y").alias("y"), F.col("p0z").alias("z")
    )
    return go.zone_progress(points, zones, ZONE_TOP)


@query(
    "a16_pose_progress",
    f"""WITH {SCENE}, done AS (SELECT idx, count(DISTINCT t) AS d FROM pairs GROUP BY idx),
    p AS (SELECT idx, coalesce(any_value(d), 0) / count(*) AS progress FROM objects LEFT JOIN done USING (idx) GROUP BY idx)
    SELECT idx, progress, abs(1 - progress) < 0.001 AS complete FROM p""",
)
def a16(spark, folder):
    return go.pose_progress(objects(spark, folder), targets(spark, folder))


# --- goals that allow certain pairs ----------------------------------------------------------------

#: On a coarse grid several objects stand on one target.  A pair is forbidden in one case of three.
GRID = f"""{b.STEPS}, objects AS (SELECT idx, t, 0.3e0 + (qty % 5) / 10.0e0 AS x, (line % 2) / 10.0e0 AS y FROM steps),
targets AS (SELECT idx, k, 0.3e0 + ((seed + k) % 5) / 10.0e0 AS x, (k % 2) / 10.0e0 AS y
  FROM (SELECT o_orderkey AS idx, o_custkey AS seed, unnest(range(0, {TARGETS_PER_EPISODE})) AS k FROM orders)),
allowed AS (SELECT o.idx, o.t, g.k, o.x, o.y, g.x AS gx, g.y AS gy FROM objects o JOIN targets g ON o.idx = g.idx AND (o.t + g.k + o.idx) % 3 <> 0),
pairs AS (SELECT idx, t, k FROM allowed WHERE sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) < 0.01)"""


def grid(spark, folder):
    """Objects, targets and allowed pairs on the grid."""
    still = [F.lit(0.0).alias("angle"), F.lit(0.0).alias("symmetry")]
    stored = b.steps(spark, folder).select(
        "idx", "t", (F.lit(0.3) + F.col("qty") % 5 / 10.0).alias("x"), (F.col("line") % 2 / 10.0).alias("y"), *still
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(TARGETS_PER_EPISODE - 1)))
    places = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("seed"), numbers.alias("k")
    )
    places = places.select(
        "idx", "k", (F.lit(0.3) + (F.col("seed") + F.col("k")) % 5 / 10.0).alias("x"), (F.col("k") % 2 / 10.0).alias("y"), still[0]
    )
    stored = settle(stored, "objects")
    allowed = stored.select("idx", "t", numbers.alias("k")).where("(t + k + idx) % 3 <> 0")
    return stored, places, allowed


@query("j7_allowed_matches", f"WITH {GRID} SELECT idx, t, CAST(k AS INTEGER) AS k FROM pairs")
def j7_allowed(spark, folder):
    return sc.allowed_matches(*grid(spark, folder))


@query(
    "j9_allowed_targets",
    f"""WITH {GRID}, takers AS (SELECT idx, k, min(t) AS t FROM pairs GROUP BY idx, k),
    away AS (SELECT idx, t, k, sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) AS d FROM allowed a
      WHERE NOT EXISTS (SELECT 1 FROM takers x WHERE x.idx = a.idx AND (x.t = a.t OR x.k = a.k))),
    best AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY idx, t ORDER BY d, k) = 1)
    SELECT idx, t, CAST(k AS INTEGER) AS k, d AS distance, row_number() OVER (PARTITION BY idx ORDER BY d DESC, t) - 1 AS rank FROM best""",
)
def j9_allowed(spark, folder):
    return go.nearest_open_target(*grid(spark, folder))


PROGRESS = """SELECT idx, coalesce(any_value(d), 0) / count(*) AS progress, abs(1 - coalesce(any_value(d), 0) / count(*)) < 0.001 AS complete
  FROM objects LEFT JOIN done USING (idx) GROUP BY idx"""


@query("a16_allowed_progress", f"WITH {GRID}, done AS (SELECT idx, count(DISTINCT t) AS d FROM pairs GROUP BY idx) {PROGRESS}")
def a16_allowed(spark, folder):
    stored, places, allowed = grid(spark, folder)
    return go.pose_progress(stored, places, allowed=allowed)


@query(
    "a16_exclusive_progress",
    f"""WITH RECURSIVE {GRID}, numbered AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY t, k) AS n FROM pairs),
    walk AS (SELECT idx, 0::BIGINT AS n, []::BIGINT[] AS ts, []::BIGINT[] AS ks FROM (SELECT DISTINCT idx FROM pairs) UNION ALL
      SELECT w.idx, p.n, CASE WHEN list_contains(ts, t) OR list_contains(ks, k) THEN ts ELSE list_append(ts, t) END,
        CASE WHEN list_contains(ts, t) OR list_contains(ks, k) THEN ks ELSE list_append(ks, k) END
      FROM walk w JOIN numbered p ON p.idx = w.idx AND p.n = w.n + 1),
    done AS (SELECT idx, len(arg_max(ts, n)) AS d FROM walk GROUP BY idx) {PROGRESS}""",
)
def a16_exclusive(spark, folder):
    stored, places, allowed = grid(spark, folder)
    return go.pose_progress(stored, places, allowed=allowed, exclusive=True)


GOALS = f"""{CONFLICTS}, goals AS (SELECT o.idx, o.t AS k, o.flag = 'N' AS oracle_only, o.p1x * 1.02e0 AS x, o.p1y AS y, g.x AS base_x, g.y AS base_y,
  EXISTS (SELECT 1 FROM pairs p WHERE p.idx = o.idx AND p.t = o.t) AS done
  FROM objects o JOIN targets g ON g.idx = o.idx AND g.k = o.t % {TARGETS_PER_EPISODE})"""


def goals(stored, target_poses):
    """Goals of an episode: all its steps, which take the targets in turn."""
    moving = stored.select(
        "idx", F.col("t").alias("k"), (F.col("t") % TARGETS_PER_EPISODE).alias("turn"), (F.col("flag") == "N").alias("oracle_only"),
        (F.col("p1x") * 1.02).alias("x"), F.col("p1y").alias("y"),
    )
    base = target_poses.select(
        "idx", F.col("k").cast("bigint").alias("turn"), F.col("x").alias("base_x"), F.col("y").alias("base_y")
    )
    done = (
        sc.pose_matches(stored, target_poses, ["idx"], "left_semi")
        .select("idx", F.col("t").alias("k"))
        .withColumn("done", F.lit(True))
    )
    return moving.join(large(base), ["idx", "turn"]).drop("turn").join(large(done), ["idx", "k"], "left").withColumn(
        "done", F.coalesce("done", F.lit(False))
    )


@query(
    "a17_rearrangement_outcome",
    f"""WITH {GOALS}, remaining AS (SELECT idx, count(*) FILTER (NOT done AND NOT oracle_only) AS n,
      bool_or(NOT (x BETWEEN 0.25 AND 0.75 AND y BETWEEN -0.5 AND 0.5)) FILTER (NOT done AND NOT oracle_only) AS off_table,
      avg(sqrt((x - base_x) * (x - base_x) + (y - base_y) * (y - base_y))) FILTER (NOT done AND NOT oracle_only) AS away FROM goals GROUP BY idx)
    SELECT o_orderkey AS idx, coalesce(n, 0) = 0 AND c.idx IS NULL AS success,
      CASE WHEN coalesce(n, 0) = 0 THEN c.idx IS NOT NULL ELSE off_table END AS failure,
      round(CASE WHEN coalesce(n, 0) = 0 THEN 0.01e0 ELSE away END, 9) AS distance
    FROM orders LEFT JOIN remaining r ON r.idx = o_orderkey LEFT JOIN conflicts c ON c.idx = o_orderkey""",
)
def a17(spark, folder):
    headers = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("idx"))
    stored, places = settle(objects(spark, folder), "objects"), targets(spark, folder)
    outcome = go.rearrangement_outcome(headers, goals(stored, places), conflicts(stored, places))
    return outcome.withColumn("distance", F.round("distance", 9))


@query(
    "a18_constraint_outcome",
    f"""WITH {b.poses_sql()}, c AS (SELECT idx, count(*) FILTER (flag = 'R') AS achieved, bool_or(qty = 50) AS violated,
      bool_or(flag = 'A' AND qty < 3) AS distracted, bool_or(flag <> 'R' AND p1x * 1.02e0 > 0.75) AS off_table, any_value(idx % 3 + 1) AS target FROM poses GROUP BY idx)
    SELECT idx, achieved, NOT violated AND NOT distracted AND achieved = target AS success,
      CASE WHEN violated OR distracted OR achieved > target THEN true WHEN achieved = target THEN false ELSE off_table END AS failure FROM c""",
)
def a18(spark, folder):
    rows = b.poses(spark, folder).select(
        "idx",
        (F.col("flag") == "R").alias("achieved"),
        (F.col("qty") == 50).alias("violates"),
        ((F.col("flag") == "A") & (F.col("qty") < 3)).alias("distractor_in_zone"),
        (F.col("p1x") * 1.02 > 0.75).alias("off_table"),
    )
    return go.constraint_outcome(rows, F.col("idx") % 3 + 1)


@query(
    "w8_order_violations",
    """WITH goals AS (SELECT l_orderkey AS idx, l_linenumber AS k, bool_or(l_returnflag = 'R') AS done FROM lineitem GROUP BY ALL),
    s AS (SELECT idx, min(k) FILTER (NOT done) AS current, max(k) AS last FROM goals GROUP BY idx)
    SELECT idx, current, EXISTS (SELECT 1 FROM goals g WHERE g.idx = s.idx AND g.done AND g.k > s.current AND g.k < s.last) AS violated FROM s""",
)
def w8(spark, folder):
    goals = (
        b.table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("k"))
        .agg(F.bool_or(F.col("l_returnflag") == "R").alias("done"))
    )
    return go.order_violations(goals)


@query(
    "w9_goal_popping",
    f"""WITH {b.STEPS}, a AS (SELECT idx, min(t) AS t1 FROM steps WHERE flag = 'R' GROUP BY idx),
    c AS (SELECT s.idx, min(t) AS t2 FROM steps s JOIN a ON a.idx = s.idx AND s.t > a.t1 WHERE flag = 'A' GROUP BY s.idx),
    d AS (SELECT s.idx, min(t) AS t3 FROM steps s JOIN c ON c.idx = s.idx AND s.t > c.t2 WHERE qty > 20 GROUP BY s.idx)
    SELECT idx, t1, t2, t3, CAST(t1 IS NOT NULL AS INTEGER) + CAST(t2 IS NOT NULL AS INTEGER) + CAST(t3 IS NOT NULL AS INTEGER) AS goals_done
    FROM (SELECT DISTINCT idx FROM steps) LEFT JOIN a USING (idx) LEFT JOIN c USING (idx) LEFT JOIN d USING (idx)""",
)
def w9(spark, folder):
    rounds = [F.col("flag") == "R", F.lit(True), F.col("flag") == "A", F.col("qty") > 20]
    steps = b.steps(spark, folder).select("idx", "t", "flag", "qty")
    return go.pop_goals(steps, rounds, skipped=[False, True, False, False])


@query(
    "w8_violations_over_time",
    f"""WITH {b.STEPS}, m AS (SELECT idx, t, flag = 'R' AS g0, qty > 30 AS g1, flag = 'A' AS g2, qty < 10 AS g3 FROM steps),
    a AS (SELECT idx, min(t) AS t1 FROM m WHERE g0 GROUP BY idx),
    c AS (SELECT m.idx, min(t) AS t2 FROM m JOIN a ON a.idx = m.idx AND t > t1 WHERE g1 GROUP BY m.idx),
    early AS (SELECT m.idx, t FROM m LEFT JOIN a USING (idx) LEFT JOIN c USING (idx)
      WHERE (t < coalesce(t1, 1000000000) AND (g1 OR g2)) OR (t > t1 AND t < coalesce(t2, 1000000000) AND g2))
    SELECT idx, (SELECT min(t) FROM early e WHERE e.idx = s.idx) AS violated_at FROM (SELECT DISTINCT idx FROM steps) s""",
)
def w8_over_time(spark, folder):
    rounds = [F.col("flag") == "R", F.col("qty") > 30, F.col("flag") == "A", F.col("qty") < 10]
    steps = b.steps(spark, folder).select("idx", "t", "flag", "qty")
    return go.follow_goals(steps, rounds).select("idx", "violated_at")


# --- pixels, frames and maps -------------------------------------------------------------------------

BOUNDS = {"x": (0.25, 0.75), "y": (-0.5, 0.5), "z": (0.0, 0.28)}
PIXEL = 0.03125
WIDTH, HEIGHT = 16, 32
HEIGHTS = f"""{b.poses_sql()}, points AS (SELECT idx, t, flag, p0x AS x, p0y AS y, p0z AS z, part % 256 AS red, supp % 256 AS green, idx * 64 + t AS id FROM poses),
mapped AS (SELECT flag AS view, least(greatest(CAST(floor((y + 0.5e0) / {PIXEL}e0) AS BIGINT), 0), {HEIGHT - 1}) AS py,
  least(greatest(CAST(floor((x - 0.25e0) / {PIXEL}e0) AS BIGINT), 0), {WIDTH - 1}) AS px, z, red, green, id
  FROM points WHERE x >= 0.25 AND x < 0.75 AND y >= -0.5 AND y < 0.5 AND z >= 0.0 AND z < 0.28),
heights AS (SELECT view, py, px, z - 0.0 AS height, red, green FROM mapped
  QUALIFY row_number() OVER (PARTITION BY view, py, px ORDER BY z DESC, id) = 1)"""


def height_maps(spark, folder):
    points = b.poses(spark, folder).select(
        F.col("flag").alias("view"), F.col("p0x").alias("x"), F.col("p0y").alias("y"), F.col("p0z").alias("z"),
        (F.col("part") % 256).alias("red"), (F.col("supp") % 256).alias("green"),
        (F.col("idx") * 64 + F.col("t")).alias("id"),
    )
    return sc.height_map(points, ["view"], BOUNDS, PIXEL, ["red", "green"])


@query("a13_height_map", f"WITH {HEIGHTS} SELECT * FROM heights")
def a13(spark, folder):
    return height_maps(spark, folder)


@query(
    "a14_fused_views",
    f"""WITH {HEIGHTS} SELECT py, px, max(height) AS height,
      CAST(round_even(sum(red) / greatest(count(*) FILTER (red + green > 0), 1), 0) AS BIGINT) AS red,
      CAST(round_even(sum(green) / greatest(count(*) FILTER (red + green > 0), 1), 0) AS BIGINT) AS green FROM heights GROUP BY py, px""",
)
def a14(spark, folder):
    return sc.fuse_views(height_maps(spark, folder), ["py", "px"], ["red", "green"])


@query("a19_detections", f"WITH {DETECTED} SELECT * FROM found")
def a19(spark, folder):
    return sc.detections(b.pixels(spark, folder), ["frame"])


@query("a19_packed_detections", f"WITH {DETECTED} SELECT * FROM found")
def a19_packed(spark, folder):
    return sc.detections_packed(b.frames(spark, folder), 8)


@query(
    "a20_half_size",
    f"WITH {b.PIXELS} SELECT frame, y // 2 AS y, x // 2 AS x, round(avg(grey), 12) AS grey FROM pixels GROUP BY ALL",
)
def a20(spark, folder):
    return sc.halve(b.pixels(spark, folder), ["frame"], "grey").withColumn("grey", F.round("grey", 12))


CROP = 3


@query(
    "a20_area_crops",
    f"""WITH {b.PIXELS}, boxes AS (SELECT frame, id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pixels GROUP BY frame, id HAVING count(*) >= 2),
    inside AS (SELECT p.frame, q.id, p.grey, CAST(greatest(y1 - y0, x1 - x0) + 1 AS DOUBLE) AS side,
      p.y - y0 + (greatest(y1 - y0, x1 - x0) - (y1 - y0)) // 2 AS sy, p.x - x0 + (greatest(y1 - y0, x1 - x0) - (x1 - x0)) // 2 AS sx
      FROM pixels p JOIN boxes q ON p.frame = q.frame AND p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1),
    grid AS (SELECT unnest(range(0, {CROP})) AS cell),
    spread AS (SELECT i.*, v.cell AS y, h.cell AS x, least(sy + 1, (v.cell + 1) * side / {CROP}) - greatest(sy, v.cell * side / {CROP}) AS fy,
      least(sx + 1, (h.cell + 1) * side / {CROP}) - greatest(sx, h.cell * side / {CROP}) AS fx FROM inside i, grid v, grid h)
    SELECT frame, id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(grey * fy * fx / (side / {CROP} * side / {CROP})), 9) AS grey
    FROM spread WHERE fy > 1e-12 AND fx > 1e-12 GROUP BY ALL""",
)
def a20_crops(spark, folder):
    pixels = b.pixels(spark, folder)
    crops = sc.area_crops(pixels, sc.boxes(pixels, ["frame"]), ["frame"], "grey", CROP)
    return crops.withColumn("grey", F.round("grey", 9))


def packed_frames(spark, folder):
    """Frames as bytes, in two views: the top view is the front view turned, its colours differ by channel."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    packed = lambda values: F.unhex(F.array_join(F.transform(values, byte), ""))
    channel = lambda grey, c: F.transform(grey, lambda g: F.floor(g * (100 + 50 * c)) % 256)
    turned = lambda a: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(a, (i % 8 * 8 + F.floor(i / 8)).cast("int")))
    stored = b.frames(spark, folder)
    views = stored.select("frame", F.lit("front").alias("view"), "ids", "grey").unionByName(
        stored.select("frame", F.lit("top").alias("view"), turned(F.col("ids")).alias("ids"), turned(F.col("grey")).alias("grey"))
    )
    return views.select(
        "frame", "view", F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.concat(*[packed(channel(F.col("grey"), c)) for c in range(3)]).alias("colours"), packed(F.col("ids")).alias("segments"),
        F.array(*[F.lit(i) for i in LISTED]).alias("objects"),
    )


def crops_sql(size: int) -> str:
    """The crops of both views as SQL text: one weighted sum per object and channel."""
    s = f"{size}.0e0"
    part = lambda axis: (
        f"CASE WHEN side >= {size} THEN (least({axis}.p + 1, (cell + 1) * side / {s}) - greatest({axis}.p, cell * side / {s})) * {s} / side"
        f" WHEN {axis}.p = least(cell * side // {size}, side - 1) THEN 1 - {axis}.f WHEN {axis}.p = cell * side // {size} + 1 THEN {axis}.f ELSE 0 END"
    )
    fraction = (
        f"CASE WHEN cell * side // {size} >= side - 1 THEN 0 ELSE"
        f" greatest((cell + 1) - (cell * side // {size} + 1) * {s} / side, 0) - floor(greatest((cell + 1) - (cell * side // {size} + 1) * {s} / side, 0)) END"
    )
    return f"""WITH {b.PIXELS}, seen AS (SELECT frame, 'front' AS view, y, x, id, grey FROM pixels UNION ALL SELECT frame, 'top', x, y, id, grey FROM pixels),
boxes AS (SELECT frame, view, id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM seen
  WHERE id IN ({', '.join(map(str, LISTED))}) GROUP BY ALL HAVING count(*) >= 2),
inside AS (SELECT q.frame, q.view, q.id, p.grey, greatest(y1 - y0, x1 - x0) + 1 AS side, y1 - y0 AS bh, x1 - x0 AS bw, (x0 + x1) // 2 AS xc, (y0 + y1) // 2 AS yc,
  p.y - y0 + (greatest(y1 - y0, x1 - x0) - (y1 - y0)) // 2 AS sy, p.x - x0 + (greatest(y1 - y0, x1 - x0) - (x1 - x0)) // 2 AS sx
  FROM seen p JOIN boxes q ON p.frame = q.frame AND p.view = q.view AND p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1),
sides AS (SELECT DISTINCT side FROM inside),
cells AS (SELECT side, cell, {fraction} AS f FROM sides, (SELECT unnest(range(0, {size})) AS cell)),
weights AS (SELECT side, cell, p, {part("w")} AS share FROM (SELECT c.*, p FROM cells c JOIN (SELECT side, unnest(range(0, side)) AS p FROM sides) q USING (side)) w),
kept AS (SELECT * FROM weights WHERE share > 1e-12),
-- the sum over all target pixels of value * place splits into sums along the two axes
along AS (SELECT side, p, sum(share) AS one, sum(share * cell) AS place FROM kept GROUP BY ALL)
SELECT i.frame, i.view, i.id, c AS channel, any_value(xc) AS xc, any_value(yc) AS yc, any_value(bh) AS h, any_value(bw) AS w,
  round(sum(floor(grey * (100 + 50 * c)) % 256 * v.one * h.one), 3) AS total, round(sum(floor(grey * (100 + 50 * c)) % 256 * v.place * h.place), 3) AS placed
FROM inside i JOIN along v ON v.side = i.side AND v.p = sy JOIN along h ON h.side = i.side AND h.p = sx, (SELECT unnest(range(0, 3)) AS c)
GROUP BY ALL"""


def crop_sums(spark, folder, size):
    """Each visible object's box and, by channel, the sum of its crop and the sum weighted by place."""

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        place = np.arange(size)
        for batch in batches:
            status, masks, crops = (batch.column(n).to_pylist() for n in ("status", "mask", "crops"))
            totals, placed = [], []
            for state, mask, data in zip(status, masks, crops):
                seen = zip(mask, data) if state == "ok" else ()
                crop = [np.frombuffer(c, "<f8").reshape(3, size, size) for visible, c in seen if visible]
                totals.append([c.sum((1, 2)).tolist() for c in crop])
                placed.append([(c * place[:, None] * place).sum((1, 2)).tolist() for c in crop])
            kept = ["frame", "view", "status", "ids", "bbox", "mask"]
            made = [pa.array(v, pa.list_(pa.list_(pa.float64()))) for v in (totals, placed)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *made], names=[*kept, "totals", "placed"])

    # the sums are taken where the crops are made, a few frames at a time: pixels never leave their task
    sums_ddl = "frame bigint, view string, status string, ids array<int>, bbox array<array<int>>, mask array<boolean>, totals array<array<double>>, placed array<array<double>>"
    found = object_crops(packed_frames(spark, folder), ["frame", "view"], size, number="<f8", then=(summed, sums_ddl))
    # visible objects come first, so their places are those of the sums
    objects_ = found.where("status = 'ok'").select(
        "frame", "view", F.inline(F.arrays_zip("ids", "bbox", "mask", "totals", "placed"))
    ).where("mask")
    sums = objects_.select(
        "frame", "view", F.col("ids").alias("id"), "bbox", F.inline(F.arrays_zip("totals", "placed", F.array(*[F.lit(c).cast("bigint") for c in range(3)]).alias("channel")))
    ).withColumnsRenamed({"totals": "total"})
    box = [F.get("bbox", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(["xc", "yc", "h", "w"])]
    return sums.select("frame", "view", "id", "channel", *box, F.round("total", 3).alias("total"), F.round("placed", 3).alias("placed"))


@query("a20_packed_crops", crops_sql(32))
def a20_packed(spark, folder):
    return crop_sums(spark, folder, 32)


@query("a20_shrunk_crops", crops_sql(4))
def a20_shrunk(spark, folder):
    return crop_sums(spark, folder, 4)


@query(
    "m12_padded_slots",
    f"""WITH {SLOTS}, n AS (SELECT *, count(*) FILTER (mask) OVER (PARTITION BY frame) AS visible FROM slots)
    SELECT frame, id, xc, yc, h, w, mask, row_number() OVER (PARTITION BY frame ORDER BY NOT mask, id) - 1 AS slot,
      CASE WHEN visible > 0 THEN 'ok' ELSE 'nothing visible' END AS status FROM n""",
)
def m12(spark, folder):
    return sc.pad_slots(slots(spark, folder), ["frame"])


RGB = ", ".join(
    f"CASE id {' '.join(f'WHEN {i} THEN {rgb[n]}' for i, rgb in enumerate(dims.SEGMENT_PALETTE))} END AS {c}"
    for n, c in enumerate("rgb")
)


@query(
    "m13_palette_frames",
    f"""WITH {b.PIXELS}, wide AS (SELECT frame, y, x, id * 3 AS id FROM pixels)
    SELECT frame, y, x, id, CASE WHEN bad THEN 'reject' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN r END AS r, CASE WHEN NOT bad THEN g END AS g,
      CASE WHEN NOT bad THEN b END AS b FROM (SELECT *, {RGB}, max(id) OVER (PARTITION BY frame) >= 20 AS bad FROM wide)""",
)
def m13(spark, folder):
    wide = b.pixels(spark, folder).select("frame", "y", "x", (F.col("id") * 3).alias("id"))
    return sc.palette_colours(wide, ["frame"])


@query(
    "m13_stacked_frames",
    f"""WITH {b.PIXELS}, coloured AS (SELECT frame, y, x, id * 3 AS id FROM pixels QUALIFY max(id * 3) OVER (PARTITION BY frame) < 20), rgb AS (SELECT frame, y, x, {RGB} FROM coloured)
    SELECT frame, string_agg(printf('%d/%d/%d', r, g, b), ' ' ORDER BY y, x) AS stacked FROM rgb GROUP BY frame""",
)
def m13_stacked(spark, folder):
    wide = b.pixels(spark, folder).select("frame", "y", "x", (F.col("id") * 3).alias("id"))
    stacked = sc.stack_frames(sc.palette_colours(wide, ["frame"]).where("status = 'ok'"), ["frame"], ["r", "g", "b"])
    as_text = lambda p: F.array_join(F.transform(p, lambda v: v.cast("string")), "/")
    return stacked.select("frame", F.array_join(F.transform("pixels", as_text), " ").alias("stacked"))


@query(
    "m14_point_cloud",
    f"""WITH {b.PIXELS}, cam AS (SELECT frame, y, x, (x - 3.5e0) * (grey / 6.0e0) AS cx, (y - 3.5e0) * (grey / 6.5e0) AS cy, grey AS cz FROM pixels)
    SELECT frame, y, x, round(0.6e0 * cx - 0.8e0 * cy + 0.5e0, 9) AS wx, round(0.8e0 * cx + 0.6e0 * cy - 0.1e0, 9) AS wy, round(cz + 1.0e0, 9) AS wz FROM cam""",
)
def m14(spark, folder):
    points = P.depth_to_point(F.col("x"), F.col("y"), F.col("grey"), 6.0, 6.5, 3.5, 3.5)
    turn = [F.lit(0.0), F.lit(0.0), F.lit(math.sqrt(0.2)), F.lit(math.sqrt(0.8))]
    moved = P.move_point(points, [F.lit(0.5), F.lit(-0.1), F.lit(1.0)], turn)
    return b.pixels(spark, folder).select(
        "frame", "y", "x", *[F.round(m, 9).alias(n) for m, n in zip(moved, ["wx", "wy", "wz"], strict=True)]
    )


@query(
    "m15_pixel_world",
    f"""WITH {b.poses_sql()}, px AS (SELECT idx, t, CAST(round_even((p0y + 0.5e0) / {PIXEL}e0, 0) AS BIGINT) AS u,
      CAST(round_even((p0x - 0.25e0) / {PIXEL}e0, 0) AS BIGINT) AS v FROM poses)
    SELECT idx, t, u, v, 0.25e0 + v * {PIXEL}e0 AS x, -0.5e0 + u * {PIXEL}e0 AS y FROM px""",
)
def m15(spark, folder):
    u, v = P.world_to_pixel(F.col("p0x"), F.col("p0y"), 0.25, -0.5, PIXEL)
    pixels = b.poses(spark, folder).select("idx", "t", u.alias("u"), v.alias("v"))
    x, y = P.pixel_to_world(F.col("u"), F.col("v"), 0.25, -0.5, PIXEL)
    return pixels.select("idx", "t", "u", "v", x.alias("x"), y.alias("y"))


@query(
    "m16_rotations",
    f"""WITH {b.poses_sql()}, n AS (SELECT idx, t, r0x AS x, r0y AS y, r0z AS z, r0w AS w, r1x, r1y, r1z, r1w, p0x, p0y, p0z,
      2.0e0 / (r0x * r0x + r0y * r0y + r0z * r0z + r0w * r0w) AS s FROM poses WHERE r0x * r0x + r0y * r0y + r0z * r0z + r0w * r0w > 1e-3),
    m AS (SELECT *, 1 - s * (y * y + z * z) AS m00, s * (x * y - z * w) AS m01, s * (x * z + y * w) AS m02, s * (x * y + z * w) AS m10,
      1 - s * (x * x + z * z) AS m11, s * (y * z - x * w) AS m12, 1 - s * (x * x + y * y) AS m22 FROM n),
    c AS (SELECT *, sqrt(m22 * m22 + m02 * m02) AS c FROM m)
    SELECT idx, t, round(atan2(-m12, c), 7) AS ax, round(CASE WHEN c > 1e-9 THEN atan2(m02, m22) ELSE 0.0e0 END, 7) AS ay,
      round(CASE WHEN c > 1e-9 THEN atan2(m10, m11) ELSE atan2(-m01, m00) END, 7) AS az,
      round(w * r1x + x * r1w + y * r1z - z * r1y, 9) AS qx, round(w * r1w - x * r1x - y * r1y - z * r1z, 9) AS qw,
      round(m00 * p0x + m01 * p0y + m02 * p0z + 0.5e0, 9) AS mx FROM c""",
)
def m16(spark, folder):
    names = ["r0x", "r0y", "r0z", "r0w"]
    q = [F.col(c) for c in names]
    length = sum((c * c for c in q[1:]), q[0] * q[0])
    ax, ay, az = P.quaternion_to_euler(*q)
    product = P.quaternion_product(q, [F.col(c) for c in ("r1x", "r1y", "r1z", "r1w")])
    moved = P.move_point(
        [F.col(c) for c in ("p0x", "p0y", "p0z")], [F.lit(0.5), F.lit(0.0), F.lit(0.0)], q
    )
    poses = b.poses(spark, folder).where(length > 1e-3)
    return poses.select(
        "idx", "t", F.round(ax, 7).alias("ax"), F.round(ay, 7).alias("ay"), F.round(az, 7).alias("az"),
        F.round(product[0], 9).alias("qx"), F.round(product[3], 9).alias("qw"), F.round(moved[0], 9).alias("mx"),
    )


@query(
    "m17_scaled_sizes",
    f"""WITH {b.PARTS} SELECT part, size * 0.5e0 AS uniform_x, retail * 0.5e0 AS uniform_y, size * 0.5e0 AS axis_x, retail * 2.0e0 AS axis_y, 3.0e0 AS axis_z FROM parts""",
)
def m17(spark, folder):
    sizes = F.array(F.col("size").cast("double"), F.col("retail"), F.lit(2.0))
    rows = b.parts(spark, folder).select(
        "part",
        at.scaled(sizes, 0.5).alias("u"),
        at.scaled(sizes, [0.5, 2.0, 1.5]).alias("a"),
    )
    return rows.select(
        "part", F.col("u")[0].alias("uniform_x"), F.col("u")[1].alias("uniform_y"),
        F.col("a")[0].alias("axis_x"), F.col("a")[1].alias("axis_y"), F.col("a")[2].alias("axis_z"),
    )


SYMMETRY = f"CASE size % 4 WHEN 0 THEN {2 * math.pi!r}e0 WHEN 1 THEN {2 * math.pi * (1 + 5e-7)!r}e0 WHEN 2 THEN {2 * math.pi * (1 + 5e-6)!r}e0 ELSE 0.0e0 END"


@query(
    "m18_no_symmetry",
    f"""WITH {b.PARTS} SELECT part, noun, size FROM parts WHERE size % 4 IN (0, 1)""",
)
def m18(spark, folder):
    rows = b.parts(spark, folder).withColumn("symmetry", F.expr(SYMMETRY))
    return rows.where(P.no_rotational_symmetry(F.col("symmetry"))).select("part", "noun", "size")


@query(
    "t16_dark_colours",
    f"""WITH {POINTS}, v AS (SELECT *, greatest(r, g, b) AS v FROM points), f AS (SELECT *, CASE WHEN v > 0 THEN greatest(0.0e0, v - 0.3e0) / v ELSE 0.0e0 END AS f FROM v)
    SELECT vec_id, 'dark colour ' || vec_id AS name, r * f AS r, g * f AS g, b * f AS b FROM f""",
)
def t16(spark, folder):
    channel = lambda i: F.least(F.abs(F.col("embedding")[i].cast("double")) * 4, F.lit(1.0))
    dark = P.darken(channel(0), channel(1), channel(2))
    name = F.concat(F.lit("dark "), F.lit("colour "), F.col("vec_id").cast("string"))
    return b.table(spark, folder, "embeddings").select(
        "vec_id", name.alias("name"), *[c.alias(n) for c, n in zip(dark, "rgb", strict=True)]
    )


VIEWS = f"""{b.PIXELS}, views AS (SELECT frame, 'top' AS view, id, x, y FROM pixels UNION ALL SELECT frame, 'front', id, x, y FROM pixels WHERE y < 3),
seen AS (SELECT frame, view, id FROM views GROUP BY ALL HAVING count(*) >= 2),
listed AS (SELECT l.frame, l.view, l.id, s.id IS NOT NULL AS mask FROM (SELECT vec_id AS frame, v.view, CAST(unnest({LISTED}) AS INTEGER) AS id
  FROM embeddings, (VALUES ('top'), ('front')) AS v(view)) l LEFT JOIN seen s USING (frame, view, id))"""


@query(
    "w11_shuffled_objects",
    f"""WITH {VIEWS} SELECT frame, view, id, mask, row_number() OVER (PARTITION BY frame, view
      ORDER BY NOT mask, CASE WHEN mask THEN {sql_hash("shuffle", "frame", "id")} ELSE '' END, id) - 1 AS slot FROM listed""",
)
def w11(spark, folder):
    pixels = b.pixels(spark, folder)
    views = F.explode(
        F.when(F.col("y") < 3, F.array(F.lit("top"), F.lit("front"))).otherwise(F.array(F.lit("top")))
    )
    found = sc.detections(pixels.withColumn("view", views), ["frame", "view"])
    frames = b.frames(spark, folder).select(
        "frame", F.explode(F.array(F.lit("top"), F.lit("front"))).alias("view")
    )
    listed = sc.fill_slots(frames, LISTED, found, ["frame", "view"]).select("frame", "view", "id", "mask")
    return sq.shuffle_objects(listed, ["frame"], "view", "shuffle")


@query(
    "l11_weighted_sample",
    f"""WITH {b.PIXELS}, drawn AS (SELECT frame, y, x, -ln((('0x' || substr({sql_hash("draw", "frame", "y", "x")}, 1, 8))::BIGINT + 0.5e0) / 4294967296.0e0) / grey AS draw
      FROM pixels WHERE grey > 0)
    SELECT frame, y, x, round(draw, 6) AS draw FROM drawn QUALIFY row_number() OVER (PARTITION BY frame ORDER BY drawn.draw, y, x) <= 5""",
)
def l11(spark, folder):
    cells = b.pixels(spark, folder).select("frame", "y", "x", "grey")
    drawn = sq.weighted_sample(cells, ["frame"], ["y", "x"], "grey", 5, "draw")
    return drawn.select("frame", "y", "x", F.round("draw", 6).alias("draw"))
