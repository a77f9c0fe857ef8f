"""Run tables and reports bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodium import dims
from episodium.operators import datasets as ds
from episodium.operators import evaluation as ev
from episodium.operators import runs as ru
from episodium.plans import bindings as b
from episodium.plans.evaluation_queries import PERFORMANCE, RUN_OF_SEED, RUNS
from episodium.plans.registry import query

# --- runs: one per customer ---------------------------------------------------------------------

MODELS = [*dims.TRAINED_INSTRUCTION, "unheardof", "  "]
TRANSFORMS = [
    ["transforms.NoopTransform"],
    ["transforms.TextualDescriptionTransform"],
    ["transforms.RewordPromptTransform"],
    ["transforms.GobbledyGookPromptWordTransform"],
    ["transforms.ChainTransform", "transforms.TextualDescriptionTransform", "transforms.GobbledyGookPromptTokenTransform"],
    ["transforms.DifferentInstructionTransform"],
    ["transforms.ChainTransform", "transforms.RewordPromptTransform", "transforms.GobbledyGookPromptTokenTransform"],
]
DIFFICULTIES = ["easy", "easy", "distracting", "extreme", "extremely_distracting"]
LIMITS = ["oracle_max_steps", "num_dragged_obj", "20"]
METHODS = [None, "underspecify_nouns", None, "remove_textures", "remove_nouns"]


def numbered(options: list) -> dict[int, object]:
    return dict(enumerate(options))


RUN_COLUMNS = {
    "model_id": (MODELS, "c_custkey % 26"),
    "difficulty": (DIFFICULTIES, "c_nationkey % 5"),
    "max_timesteps": (LIMITS, "c_custkey % 3"),
}


def run_table(spark, folder):
    customers = b.table(spark, folder, "customer")
    pick = lambda options, key: b.lookup(numbered(options), F.expr(key).cast("int"))
    targets = F.get(
        F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in TRANSFORMS]), (F.col("c_custkey") % 7).cast("int")
    )
    method = F.when(F.col("c_custkey") % 7 == 1, F.get(F.array(*[F.lit(m) for m in METHODS]), F.col("c_nationkey") % 5))
    return customers.select(
        F.col("c_custkey").alias("run_id"),
        *[pick(options, key).alias(name) for name, (options, key) in RUN_COLUMNS.items()],
        targets.alias("targets"),
        method.alias("method"),
        (F.col("c_nationkey") % 3 == 0).alias("no_text"),
        (F.col("c_nationkey") % 4 == 0).alias("no_visual"),
        (F.col("c_mktsegment") == "BUILDING").alias("shuffle_objects"),
    )


def model_rows() -> list[tuple]:
    return [
        (
            m, t, "dec_only" if m in dims.DECODER_ONLY else "xattn", "patches" if m in dims.PATCH_ENCODER else "obj_centric",
            m in dims.SHUFFLED_OBJECTS, m in dims.WITHOUT_TEXT, m in dims.WITHOUT_VISUAL_REFERENT,
            14 if m in dims.FOURTEEN_TOKENS else 1, m in dims.WITH_NULL_ACTION,
        )
        for m, t in dims.TRAINED_INSTRUCTION.items()
    ]


MODEL_COLUMNS = [
    "model_id", "training_data", "conditioning", "encoder", "shuffled", "without_text", "without_visual",
    "num_action_tokens", "with_null_action",
]
# label of each transform list, spelled out by hand
LABELS = {
    0: "noop", 1: "textual", 2: "reworded", 3: "gobbledygook_word", 4: "textual_gobbledygook_tokens",
    5: "diff_instruction", 6: "gobbledygook_word_gobbledygook_tokens_reworded",
}
ENRICHED = f"""{b.sql_values("models", MODEL_COLUMNS, model_rows())}, runs AS (SELECT c_custkey AS run_id,
  CASE WHEN c_custkey % 26 = 25 THEN 'Given' ELSE {b.sql_lookup(numbered(MODELS[:25]), "(c_custkey % 26)")} END AS model_id,
  {b.sql_lookup(numbered(DIFFICULTIES), "(c_nationkey % 5)")} AS difficulty, {b.sql_lookup(numbered(LIMITS), "(c_custkey % 3)")} AS max_timesteps,
  {b.sql_lookup(LABELS, "(c_custkey % 7)")} AS transform,
  CASE WHEN c_custkey % 7 = 1 THEN CASE c_nationkey % 5 WHEN 1 THEN 'underspecify_nouns' WHEN 3 THEN 'remove_textures' WHEN 4 THEN 'remove_nouns' END END AS method,
  CASE WHEN c_nationkey % 12 = 0 THEN 'disable_both' WHEN c_nationkey % 3 = 0 THEN 'disable_text' WHEN c_nationkey % 4 = 0 THEN 'disable_visual' ELSE 'disable_none' END AS modality,
  c_mktsegment = 'BUILDING' AS shuffle_objects FROM customer),
enriched AS (SELECT r.*, m.* EXCLUDE (model_id), m.model_id IS NOT NULL AS known FROM runs r LEFT JOIN models m USING (model_id))"""
TRANSFORM_CASE = b.sql_lookup(dims.TRANSFORM_WORDS, "transform")
NAMED = f"""{ENRICHED}, words AS (SELECT *, nullif({TRANSFORM_CASE}, '') AS w1, {b.sql_lookup(dims.DESCRIPTION_WORDS, "method")} AS w2,
    nullif({b.sql_lookup(dims.MODALITY_WORDS, "modality")}, '') AS w3, CASE WHEN shuffle_objects THEN 'ShufObj' END AS w4,
    {TRANSFORM_CASE} IS NULL AS nameless FROM enriched),
extras AS (SELECT *, concat_ws(' + ', w1, w2, w3, w4) AS extra FROM words),
named AS (SELECT *, CASE WHEN known AND NOT nameless THEN
    CASE conditioning WHEN 'dec_only' THEN 'D' ELSE 'X' END || '+' || CASE WHEN without_text THEN 'Only' ELSE '' END
    || CASE encoder WHEN 'patches' THEN 'Ptch' ELSE 'Obj' END || CASE WHEN shuffled THEN 'Shuf' ELSE '' END
    || CASE WHEN num_action_tokens = 14 THEN '+14' ELSE '' END || ' / '
    || CASE WHEN model_id = 'Given' THEN 'Given' WHEN training_data = 'original' THEN 'Orig' WHEN training_data = 'none' THEN 'None' ELSE 'Para' END
    || CASE WHEN with_null_action THEN 'w/Null' ELSE '' END
    || CASE WHEN extra <> '' THEN ' - ' || extra ELSE '' END
    || CASE WHEN difficulty <> 'easy' THEN ' [' || {b.sql_lookup(dims.DIFFICULTY_WORDS, "difficulty")} || ']' ELSE '' END
    || CASE max_timesteps WHEN 'oracle_max_steps' THEN ' [OracleTime]' WHEN 'num_dragged_obj' THEN ' [ObjTime]' ELSE '' END END AS run_name FROM extras)"""


@query(
    "r1_wide_metrics",
    f"""WITH {b.OUTCOMES}, v AS (SELECT {b.sql_lookup(RUN_OF_SEED, f"(seed % {len(RUNS)})")} AS run_id, partition, task,
      sum(is_successful_at_end::INT) / count(*) AS value FROM outcomes GROUP BY ALL)
    SELECT run_id, {", ".join(f"max(value) FILTER (partition = {p} AND task = {t}) AS l{p}_task{t + 1:02d}" for p, ts in dims.TASKS_PER_LEVEL.items() for t in ts)}
    FROM v GROUP BY run_id""",
)
def r1(spark, folder):
    run = b.lookup(RUN_OF_SEED, (F.col("seed") % len(RUNS)).cast("int"))
    metrics = (
        b.outcomes(spark, folder)
        .groupBy(run.alias("run_id"), ev.metric_key("success", F.col("partition"), F.col("task")).alias("key"))
        .agg((F.sum(F.col("is_successful_at_end").cast("int")) / F.count(F.lit(1))).alias("value"))
    )
    names = [f"l{p}_task{t + 1:02d}" for p, ts in dims.TASKS_PER_LEVEL.items() for t in ts]
    return ru.wide_metrics(metrics, "success", names)


@query(
    "r2_enriched_runs",
    f"""WITH {ENRICHED} SELECT run_id, model_id, training_data, conditioning, encoder, shuffled, without_text, without_visual,
      num_action_tokens, with_null_action, known FROM enriched""",
)
def r2(spark, folder):
    runs = run_table(spark, folder).select("run_id", "model_id")
    return ru.enrich(runs, ru.model_table(spark))


@query("r3_run_labels", f"WITH {ENRICHED} SELECT run_id, transform, modality FROM enriched")
def r3(spark, folder):
    return ru.with_labels(run_table(spark, folder)).select("run_id", "transform", "modality")


STATUS = "CASE WHEN NOT known THEN 'unknown model' WHEN nameless THEN 'no name' ELSE 'ok' END AS status"


@query("r4_run_names", f"WITH {NAMED} SELECT run_id, run_name, {STATUS} FROM named")
def r4(spark, folder):
    return ru.backfill(run_table(spark, folder), ru.model_table(spark)).select("run_id", "run_name", "status")


@query(
    "r5_backfilled_runs",
    f"""WITH {NAMED} SELECT run_id, model_id, transform, modality, difficulty, training_data, run_name,
      CASE WHEN NOT known THEN 'unknown model' WHEN nameless THEN 'no name' ELSE 'ok' END AS status FROM named""",
)
def r5(spark, folder):
    return ru.backfill(run_table(spark, folder), ru.model_table(spark)).select(
        "run_id", "model_id", "transform", "modality", "difficulty", "training_data", "run_name", "status"
    )


# the share of a run's task, as text with one decimal, from whole numbers only
HIDDEN = ", ".join(str(t) for t in ru.KEPT_VISUAL_IDS)
RUN_SHARES = f"""{b.EPISODES}, shares AS (SELECT seed % 3 AS run_id, partition, task,
    coalesce(sum(strict::INT), 0) / nullif(count(time_limit), 0) AS share FROM episodes GROUP BY ALL),
cells AS (SELECT run_id, partition, task, share, run_id = 1 AND task IN ({HIDDEN}) AS hidden,
    CASE WHEN NOT (run_id = 1 AND task IN ({HIDDEN})) THEN CAST(round_even(share * 100, 1) AS DECIMAL(6, 1)) END AS p FROM shares)"""


def run_performance(spark, folder):
    """Performance of three runs; the second describes objects in words."""
    episodes = b.episodes(spark, folder).withColumn("run_id", F.col("seed") % 3)
    shares = episodes.groupBy("run_id", "partition", "task").agg(
        F.try_divide(F.coalesce(F.sum(F.col("strict").cast("int")), F.lit(0)), F.count("time_limit")).alias("share")
    )
    return shares


@query(
    "r6_paper_rows",
    f"""WITH {RUN_SHARES}, grid AS (SELECT run_id, partition, unnest(range(0, 17)) AS task FROM (SELECT DISTINCT run_id, partition FROM cells))
    SELECT g.run_id, g.partition, 'L' || g.partition || ' & ' || string_agg(coalesce(CAST(p AS VARCHAR), '{dims.MISSING_CELL}'), ' & ' ORDER BY g.task) || ' & '
      || coalesce(CAST(CAST(round_even(avg(CAST(p AS DOUBLE)), 1) AS DECIMAL(6, 1)) AS VARCHAR), '{dims.MISSING_CELL}') AS line
    FROM grid g LEFT JOIN cells c ON c.run_id = g.run_id AND c.partition = g.partition AND c.task = g.task GROUP BY g.run_id, g.partition""",
)
def r6(spark, folder):
    return ru.paper_rows(run_performance(spark, folder), ["run_id"], "share", F.col("run_id") == 1)


@query(
    "r6_csv_rows",
    f"""WITH {RUN_SHARES} SELECT run_id, string_agg(CASE WHEN hidden THEN '' ELSE coalesce(CAST(p AS VARCHAR), '') END, ',' ORDER BY partition, task) AS line
    FROM cells GROUP BY run_id""",
)
def r6_csv(spark, folder):
    return ru.csv_rows(run_performance(spark, folder), ["run_id"], "share", F.col("run_id") == 1)


@query(
    "r7_textual_runs",
    f"""WITH {NAMED} SELECT run_id, run_name LIKE '%ObjText%' AS textual, CASE WHEN known THEN CASE conditioning WHEN 'xattn' THEN 'Cross-Attn' ELSE 'Concatenate' END || ' + '
      || CASE encoder WHEN 'patches' THEN 'Patches' ELSE 'Obj-Centric' END END AS title, {STATUS} FROM named""",
)
def r7(spark, folder):
    return ru.backfill(run_table(spark, folder), ru.model_table(spark)).select(
        "run_id",
        ru.is_textual_run(F.col("run_name")).alias("textual"),
        ru.model_title(F.col("conditioning"), F.col("encoder")).alias("title"),
        "status",
    )


PUBLISHED = [(p, t, r) for p, rates in dims.PUBLISHED_SUCCESS.items() for t, r in rates.items()]


@query(
    "r8_published_comparison",
    f"""WITH {PERFORMANCE}, {b.sql_values("published", ["partition", "task", "rate"], PUBLISHED)}
    SELECT printf('success/L%d/Task%02d', p.partition, p.task + 1) AS key, CAST(rate AS DOUBLE) AS published, 100 AS seen, percentage_successful AS ours,
      percentage_successful - CAST(rate AS DOUBLE) AS delta FROM published p LEFT JOIN shares s ON s.partition = p.partition AND s.task = p.task""",
)
def r8(spark, folder):
    ours = ev.task_performance(b.episodes(spark, folder)).select(
        "partition", "task", F.col("percentage_successful").alias("ours")
    )
    published = ru.published_rows(spark)
    return published.join(ours, ["partition", "task"], "left").select(
        ev.metric_key("success", F.col("partition"), F.col("task")).alias("key"),
        "published",
        "seen",
        "ours",
        (F.col("ours") - F.col("published")).alias("delta"),
    )


GRID = {
    "dataset": ["original", "reworded"],
    "shuffle": ["false", "true"],
    "modality": ["disable_none", "disable_text", "disable_visual", "disable_both"],
}


@query(
    "r9_pending_experiments",
    f"""WITH grid AS (SELECT DISTINCT c_custkey AS model, d.v AS dataset, s.v AS shuffle, m.v AS modality FROM customer,
      (SELECT unnest({GRID["dataset"]}) AS v) d, (SELECT unnest({GRID["shuffle"]}) AS v) s, (SELECT unnest({GRID["modality"]}) AS v) m),
    done AS (SELECT DISTINCT s_suppkey AS model, CASE WHEN s_nationkey % 2 = 0 THEN 'original' ELSE 'reworded' END AS dataset,
      'true' AS shuffle, CASE WHEN s_nationkey % 3 = 0 THEN 'disable_none' ELSE 'disable_both' END AS modality FROM supplier)
    SELECT * FROM grid EXCEPT SELECT * FROM done""",
)
def r9(spark, folder):
    models = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("model")).distinct()
    done = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("model"),
        F.when(F.col("s_nationkey") % 2 == 0, "original").otherwise("reworded").alias("dataset"),
        F.lit("true").alias("shuffle"),
        F.when(F.col("s_nationkey") % 3 == 0, "disable_none").otherwise("disable_both").alias("modality"),
    )
    return ru.pending_experiments(models, GRID, done.distinct())


# --- enums, groups, limits and masks ----------------------------------------------------------------

NAMES = {}
for _name, _id in dims.TASK_IDS_BY_ANY_NAME.items():
    NAMES.setdefault(_id, []).append(_name)
# every third order spells its task as a number, every seventh as an unknown word
SPELLED = "CASE WHEN idx % 7 = 0 THEN 'juggle' WHEN idx % 3 = 0 THEN CAST(task AS STRING) ELSE task_name END"


@query(
    "p3_decoded_tasks",
    f"""WITH {b.INSTANCES} SELECT idx, CASE WHEN idx % 7 = 0 THEN NULL ELSE task END AS task,
      CASE WHEN idx % 7 = 0 THEN NULL ELSE {b.sql_lookup({i: ",".join(ns) for i, ns in NAMES.items()}, "task")} END AS names FROM instances""",
)
def p3(spark, folder):
    spelled = b.instances(spark, folder).select("idx", F.expr(SPELLED).alias("spelled"))
    decoded = ds.decode_enum(F.col("spelled"), dims.TASK_IDS_BY_ANY_NAME)
    return spelled.select("idx", decoded.alias("task")).withColumn(
        "names", F.array_join(ds.names_for_id(F.col("task"), dims.TASK_IDS_BY_ANY_NAME), ",")
    )


@query(
    "p4_task_groups",
    f"""WITH {b.INSTANCES}, asked AS (SELECT CASE WHEN seed % 13 = 0 THEN 99 ELSE task END AS task FROM instances)
    SELECT task, {b.sql_lookup(dims.GROUP_OF_TASK, "task")} AS task_group, count(*) AS n, task = 99 AS missing FROM asked GROUP BY task""",
)
def p4(spark, folder):
    asked = b.instances(spark, folder).select(
        F.when(F.col("seed") % 13 == 0, F.lit(99)).otherwise(F.col("task")).alias("task")
    )
    counts = asked.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    group = ds.task_group(F.col("task"))
    return counts.select("task", group.alias("task_group"), "n", group.isNull().alias("missing"))


@query(
    "p13_hidden_modalities",
    """WITH flags AS (SELECT conv_id, turn, string_split(text, ' ') AS w, conv_id % 3 = 0 AS no_text, conv_id % 4 = 0 AS no_visual, role FROM conversations)
    SELECT conv_id, turn, CASE WHEN no_text AND no_visual THEN 'disable_both' WHEN no_text THEN 'disable_text' WHEN no_visual THEN 'disable_visual' ELSE 'disable_none' END AS modality,
      CASE WHEN no_text THEN 0 ELSE len(list_filter(w, lambda x: length(x) > 0)) END AS text_tokens,
      CASE WHEN no_visual OR role <> 'assistant' THEN 0 ELSE 6 END AS visual_tokens FROM flags""",
)
def p13(spark, folder):
    no_text, no_visual = F.col("conv_id") % 3 == 0, F.col("conv_id") % 4 == 0
    text_mask = F.transform(F.split("text", " "), lambda w: F.length(w) > 0)
    visual_mask = F.when(F.col("role") == "assistant", F.array_repeat(F.lit(True), 6)).otherwise(
        F.array().cast("array<boolean>")
    )
    on = lambda mask: F.size(F.filter(mask, lambda m: m))
    masked = b.table(spark, folder, "conversations").select(
        "conv_id", "turn", ru.modality_label(no_text, no_visual).alias("modality"),
        ru.hidden(text_mask, no_text).alias("t"), ru.hidden(visual_mask, no_visual).alias("v"),
    )
    return masked.select(
        "conv_id", "turn", "modality", on(F.col("t")).cast("bigint").alias("text_tokens"), on(F.col("v")).alias("visual_tokens")
    )


@query("p19_time_limits", f"WITH {b.EPISODES} SELECT idx, task, time_limit FROM episodes")
def p19(spark, folder):
    return ev.with_time_limit(b.outcomes(spark, folder)).select("idx", "task", "time_limit")


@query(
    "t15_level_labels",
    f"WITH {b.INSTANCES} SELECT idx, 'L' || partition AS level FROM instances",
)
def t15(spark, folder):
    return b.instances(spark, folder).select("idx", ev.level_label(F.col("partition")).alias("level"))
