"""Action tokens, masks, losses and tensors bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodium import dims
from episodium.operators import actions as ac
from episodium.operators import metric_state
from episodium.operators import datasets as ds
from episodium.operators import evaluation as ev
from episodium.plans import bindings as b
from episodium.plans.registry import query
from episodium.workspace import new_folder

AXES = b.POSE_AXIS
NAMES = list(AXES)


def unit_sql(name: str) -> str:
    low, high, _ = dims.AXIS_SPEC[AXES[name]]
    return f"(({name} - {float(low)}e0) / ({float(high)}e0 - {float(low)}e0))"


def token_sql(name: str) -> str:
    """Tokens by counting boundaries one by one."""
    bins = dims.AXIS_SPEC[AXES[name]][2]
    return f"len(list_filter(range(0, {bins}), lambda k: CAST(k AS DOUBLE) / {bins - 1}.0e0 < {unit_sql(name)}))"


@query(
    "m1_normalised_actions",
    f"WITH {b.poses_sql()} SELECT idx, t, {', '.join(f'{unit_sql(n)} AS {n}' for n in NAMES)} FROM poses",
)
def m1(spark, folder):
    return ac.normalise(b.poses(spark, folder).select("idx", "t", *NAMES), AXES)


@query(
    "m2_action_tokens",
    f"WITH {b.poses_sql()} SELECT idx, t, {', '.join(f'{token_sql(n)} AS {n}' for n in NAMES)} FROM poses",
)
def m2(spark, folder):
    return ac.tokenise(b.poses(spark, folder).select("idx", "t", *NAMES), AXES)


def back_sql(name: str) -> str:
    low, high, bins = dims.AXIS_SPEC[AXES[name]]
    return f"least(k_{name}, {bins}) / {bins}.0e0 * ({float(high)}e0 - {float(low)}e0) + {float(low)}e0"


@query(
    "m3_continuous_actions",
    f"""WITH {b.poses_sql()}, tokens AS (SELECT idx, t, {', '.join(f'{token_sql(n)} AS k_{n}' for n in NAMES)} FROM poses)
    SELECT idx, t, {', '.join(f'{back_sql(n)} AS {n}' for n in NAMES)} FROM tokens""",
)
def m3(spark, folder):
    return ac.detokenise(ac.tokenise(b.poses(spark, folder).select("idx", "t", *NAMES), AXES), AXES)


def clamp_sql(name: str) -> str:
    low, high, _ = dims.AXIS_SPEC[AXES[name]]
    return f"greatest({float(low)}e0, least({float(high)}e0, {name} * 1.5e0)) AS {name}"


@query(
    "m4_clamped_actions",
    f"WITH {b.poses_sql()} SELECT idx, t, {', '.join(clamp_sql(n) for n in NAMES if AXES[n] != 'z')} FROM poses",
)
def m4(spark, folder):
    wide = b.poses(spark, folder).select("idx", "t", *[(F.col(n) * 1.5).alias(n) for n in NAMES])
    return ac.clamp(wide, AXES)


@query(
    "m5_timestep_mask",
    f"""WITH {b.poses_sql(padded=True)} SELECT idx, t, {' AND '.join(f'{n} = -100' for n in NAMES)} AS masked FROM poses""",
)
def m5(spark, folder):
    return b.poses(spark, folder, padded=True).select("idx", "t", ac.timestep_masked(NAMES).alias("masked"))


@query(
    "m6_target_tokens",
    f"""WITH {b.poses_sql(padded=True)}, long AS ({' UNION ALL '.join(
        f"SELECT {i} AS axis, CASE WHEN {n} = -100 THEN -100 ELSE {token_sql(n)} END AS token FROM poses"
        for i, n in enumerate(NAMES))})
    SELECT axis, token, count(*) AS n FROM long GROUP BY axis, token""",
)
def m6(spark, folder):
    targets = ac.target_tokens(b.poses(spark, folder, padded=True), AXES)
    return targets.groupBy("axis", "token").agg(F.count(F.lit(1)).alias("n"))


PARTS = {"pose0_position": 3, "pose0_rotation": 4, "pose1_position": 3, "pose1_rotation": 4}


@query(
    "m7_decoded_actions",
    f"""WITH {b.LOGITS}, best AS (SELECT step, axis, list_position(logits, list_max(logits)) - 1 AS token FROM logits),
    s AS (SELECT step, list(token ORDER BY axis) AS k FROM best GROUP BY step)
    SELECT step, CASE WHEN len(k) = 14 THEN 'ok' ELSE 'axes missing' END AS status,
      CASE WHEN len(k) = 14 THEN array_to_string(k[1:3], ',') END AS pose0_position, CASE WHEN len(k) = 14 THEN array_to_string(k[4:7], ',') END AS pose0_rotation,
      CASE WHEN len(k) = 14 THEN array_to_string(k[8:10], ',') END AS pose1_position, CASE WHEN len(k) = 14 THEN array_to_string(k[11:14], ',') END AS pose1_rotation FROM s""",
)
def m7(spark, folder):
    decoded = ac.decode_actions(b.logits(spark, folder), PARTS)
    return decoded.select(
        "step", "status", *[F.array_join(F.transform(p, lambda v: v.cast("string")), ",").alias(p) for p in PARTS]
    )


LOSS = f"""{b.LOGITS}, losses AS (SELECT step, axis, target, list_position(logits, list_max(logits)) - 1 AS predicted,
  CASE WHEN target <> -100 THEN list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
    - logits[target + 1] END AS loss FROM logits)"""


@query(
    "a10_axis_loss",
    f"WITH {LOSS} SELECT step, axis, target, predicted, round(loss, 9) AS loss FROM losses",
)
def a10(spark, folder):
    return ac.fine_grained_loss(b.logits(spark, folder)).withColumn("loss", F.round("loss", 9))


@query(
    "a11_reduced_loss",
    f"""WITH {LOSS}, per_step AS (SELECT step, CASE WHEN count(*) = count(loss) THEN avg(loss) END AS loss FROM losses GROUP BY step)
    SELECT count(loss) AS steps, round(avg(loss), 9) AS loss FROM per_step""",
)
def a11(spark, folder):
    reduced = ac.reduced_loss(ac.fine_grained_loss(b.logits(spark, folder)))
    return reduced.withColumn("loss", F.round("loss", 9))


LABELS = {i: label for i, label in enumerate(ac.AXIS_LABELS)}


@query(
    "a12_offline_metrics",
    f"""WITH {LOSS} SELECT {b.sql_lookup(LABELS, "axis")} AS axis, count(*) FILTER (target <> -100) AS targets,
      round(avg(loss), 9) AS loss, count(*) FILTER (target <> -100 AND predicted = target) / nullif(count(*) FILTER (target <> -100), 0) AS accuracy
    FROM losses GROUP BY losses.axis""",
)
def a12(spark, folder):
    metrics = ac.offline_metrics(ac.fine_grained_loss(b.logits(spark, folder)))
    return metrics.withColumn("loss", F.round("loss", 9))


@query(
    "a12_exact_match",
    f"""WITH {LOSS}, steps AS (SELECT step, count(*) FILTER (target <> -100 AND predicted <> target) = 0 AS ok FROM losses GROUP BY step)
    SELECT count(*) AS examples_seen, count(*) FILTER (ok) / count(*) AS exact_match FROM steps""",
)
def a12_exact(spark, folder):
    return ac.exact_match(ac.fine_grained_loss(b.logits(spark, folder)))


@query(
    "u3_merged_losses",
    f"""WITH {LOSS} SELECT {b.sql_lookup(LABELS, "axis")} AS axis, count(*) FILTER (target <> -100) AS targets,
      round(avg(loss), 9) AS loss, count(*) FILTER (target <> -100 AND predicted = target) / nullif(count(*) FILTER (target <> -100), 0) AS accuracy
    FROM losses GROUP BY losses.axis""",
)
def u3_losses(spark, folder):
    losses = ac.fine_grained_loss(b.logits(spark, folder))
    state = metric_state.offline_state(spark, new_folder(spark, "metric-state"))
    for part in (0, 1, 0):  # the first batch is replayed
        state.update(losses.where(F.col("step") % 2 == part), f"part-{part}")
    return metric_state.offline_rows(state).withColumn("loss", F.round("loss", 9))


# --- checks ------------------------------------------------------------------------------------

TOKEN_CHECK = " AND ".join(
    f"k_{n} >= 0" + ("" if AXES[n] == "z" else f" AND k_{n} < {dims.AXIS_SPEC[AXES[n]][2]}") for n in NAMES
)


@query(
    "p7_validated_actions",
    f"""WITH {b.poses_sql()}, tokens AS (SELECT idx, t, part, {', '.join(f'{token_sql(n)} AS k_{n}' for n in NAMES)} FROM poses)
    SELECT idx, t, part % 50 <> 0 AS position_ok, part % 30 <> 0 AS rotation_ok, {TOKEN_CHECK} AS tokens_ok,
      part % 50 <> 0 AND part % 30 <> 0 AND {TOKEN_CHECK} AS accepted FROM tokens""",
)
def p7(spark, folder):
    # every 50th object has a position of four numbers, every 30th a rotation of three
    poses = b.poses(spark, folder)
    position = F.array("p0x", "p0y", "p0z")
    rotation = F.array("r0x", "r0y", "r0z", "r0w")
    shaped = poses.select(
        "idx",
        "t",
        F.when(F.col("part") % 50 == 0, F.concat(position, F.array("p0x"))).otherwise(position).alias("position"),
        F.when(F.col("part") % 30 == 0, F.slice(rotation, 1, 3)).otherwise(rotation).alias("rotation"),
        *NAMES,
    )
    checked = ds.accept_reject(
        ac.tokenise(shaped, AXES),
        {
            "position_ok": F.size("position") == 3,
            "rotation_ok": F.size("rotation") == 4,
            "tokens_ok": ac.token_ranges_ok(AXES),
        },
    )
    return checked.select("idx", "t", "position_ok", "rotation_ok", "tokens_ok", "accepted")


def near(expression: str, target: float) -> str:
    return f"abs({expression} - {target}e0) <= 1e-8 + 1e-5 * abs({target}e0)"


@query(
    "p12_pointless_actions",
    f"""WITH {b.poses_sql()}, nudged AS (SELECT idx, t, part % 4 = 0 AS still, p0x, qty FROM poses)
    SELECT idx, t, still AND {near("(0.5e0 + (qty - 25.0e0) / 5e6)", 0.5)} AS pointless FROM nudged""",
)
def p12(spark, folder):
    # a quarter of the steps stays at the starting pose, give or take a few millionths
    still = F.col("part") % 4 == 0
    x = F.when(still, F.lit(0.5) + (F.col("qty") - F.lit(25.0)) / F.lit(5e6)).otherwise(F.col("p0x") + 1)
    rest = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    poses = b.poses(spark, folder)
    return poses.select(
        "idx", "t", ev.is_pointless([x, F.lit(0.0)], rest, [F.lit(0.5), F.lit(0.0)], rest).alias("pointless")
    )
