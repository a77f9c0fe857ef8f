"""Evaluation runs: enrichment, names and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodium import dims
from episodium.operators.evaluation import rounded_percent


def model_table(spark: SparkSession) -> DataFrame:
    """Properties of the known trained models, one row each."""
    rows = [
        (
            model,
            training,
            "dec_only" if model in dims.DECODER_ONLY else "xattn",
            "patches" if model in dims.PATCH_ENCODER else "obj_centric",
            model in dims.SHUFFLED_OBJECTS,
            model in dims.WITHOUT_TEXT,
            model in dims.WITHOUT_VISUAL_REFERENT,
            14 if model in dims.FOURTEEN_TOKENS else 1,
            model in dims.WITH_NULL_ACTION,
        )
        for model, training in dims.TRAINED_INSTRUCTION.items()
    ]
    schema = (
        "model_id string, training_data string, conditioning string, encoder string, shuffled boolean, "
        "without_text boolean, without_visual boolean, num_action_tokens int, with_null_action boolean"
    )
    return spark.createDataFrame(rows, schema)


def enrich(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Runs with the properties of their model; unknown models are marked, not dropped.

    A blank model id stands for the given model.
    """
    trimmed = F.trim("model_id")
    model = F.when(trimmed == "", F.lit("Given")).otherwise(trimmed)
    return (
        runs.withColumn("model_id", model)
        .join(models, "model_id", "left")
        .withColumn("known", F.col("training_data").isNotNull())
    )


def transform_label(targets: Column) -> Column:
    """Label of the prompt transforms of a run, from the names of its transform classes."""
    has = lambda word: F.exists(targets, lambda t: F.contains(F.lower(t), F.lit(word)))
    nonsense = has("gobbledygook")
    label = F.concat_ws(
        "_",
        F.when(has("textual"), F.lit("textual")),
        F.when(has("word") & nonsense, F.lit("gobbledygook_word")),
        F.when(has("token") & nonsense, F.lit("gobbledygook_tokens")),
        F.when(has("reword"), F.lit("reworded")),
        F.when(has("instruction"), F.lit("diff_instruction")),
    )
    return F.when(label == "", F.lit("noop")).otherwise(label)


def modality_label(no_text: Column, no_visual: Column) -> Column:
    """Which parts of the prompt a run hides."""
    return (
        F.when(no_text & no_visual, F.lit("disable_both"))
        .when(no_text, F.lit("disable_text"))
        .when(no_visual, F.lit("disable_visual"))
        .otherwise(F.lit("disable_none"))
    )


def _word(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _some(text: Column) -> Column:
    """NULL instead of an empty string, so that joining skips it."""
    return F.when(text != "", text)


def display_name() -> Column:
    """Display name of an enriched run with transform, modality, method, difficulty and limit.

    NULL if the combination of transforms or the difficulty has no name.
    """
    model = F.concat(
        _word(dims.CONDITIONING_LETTER, F.col("conditioning")),
        F.lit("+"),
        F.when(F.col("without_text"), F.lit("Only")).otherwise(F.lit("")),
        _word(dims.ENCODER_WORD, F.col("encoder")),
        F.when(F.col("shuffled"), F.lit("Shuf")).otherwise(F.lit("")),
        F.when(F.col("num_action_tokens") == 14, F.lit("+14")).otherwise(F.lit("")),
        F.lit(" / "),
        F.when(F.col("model_id") == "Given", F.lit("Given")).otherwise(
            F.initcap(F.substring("training_data", 1, 4))
        ),
        F.when(F.col("with_null_action"), F.lit("w/Null")).otherwise(F.lit("")),
    )
    transform = _word(dims.TRANSFORM_WORDS, F.col("transform"))
    extras = F.concat_ws(
        " + ",
        _some(transform),
        _word(dims.DESCRIPTION_WORDS, F.col("method")),
        _some(_word(dims.MODALITY_WORDS, F.col("modality"))),
        F.when(F.col("shuffle_objects"), F.lit("ShufObj")),
    )
    difficulty = _word(dims.DIFFICULTY_WORDS, F.col("difficulty"))
    limit = _word(dims.TIME_LIMIT_WORDS, F.col("max_timesteps"))
    named = F.concat(
        model,
        F.when(extras != "", F.concat(F.lit(" - "), extras)).otherwise(F.lit("")),
        F.when(F.col("difficulty") != "easy", F.concat(F.lit(" ["), difficulty, F.lit("]"))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" ["), limit, F.lit("]")), F.lit("")),
    )
    return F.when(transform.isNotNull(), named)


def with_labels(runs: DataFrame) -> DataFrame:
    """Runs with transform and modality label."""
    return runs.withColumn("transform", transform_label(F.col("targets"))).withColumn(
        "modality", modality_label(F.col("no_text"), F.col("no_visual"))
    )


def backfill(runs: DataFrame, models: DataFrame) -> DataFrame:
    """All runs enriched, labelled and named; ``status`` tells which of them could not be."""
    done = enrich(with_labels(runs), models).withColumn("run_name", display_name())
    status = (
        F.when(~F.col("known"), F.lit("unknown model"))
        .when(F.col("run_name").isNull(), F.lit("no name"))
        .otherwise(F.lit("ok"))
    )
    return done.withColumn("status", status)


def is_textual_run(name: Column) -> Column:
    """Whether a run describes objects in words."""
    lower = F.lower(name)
    return F.contains(lower, F.lit("textual")) | F.contains(lower, F.lit("objtext"))


def model_title(conditioning: Column, encoder: Column) -> Column:
    """Model name as printed."""
    return F.concat(_word(dims.MODEL_TITLE, conditioning), F.lit(" + "), _word(dims.ENCODER_TITLE, encoder))


def wide_metrics(metrics: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """One row per run with a column per metric key: ``success/L1/Task01`` becomes ``l1_task01``."""
    key = F.lower(F.replace(F.replace("key", F.lit(f"{prefix}/"), F.lit("")), F.lit("/"), F.lit("_")))
    named = metrics.where(F.startswith("key", F.lit(prefix + "/"))).withColumn("name", key)
    return named.groupBy("run_id").pivot("name", names).agg(F.first("value"))


KEPT_VISUAL_IDS = [dims.TASKS[t] for t in dims.TASKS_KEPT_VISUAL]


def paper_rows(performance: DataFrame, by: list[str], share: str, textual: Column) -> DataFrame:
    """A printed line per run and level: all 17 tasks, then the average of the shown values.

    A missing task, or one a textual run avoids, shows a dash.  Performance has one row per task,
    so a line gathers at most 17 values.
    """
    task = F.col("task")
    hidden = textual & task.isin(KEPT_VISUAL_IDS)
    shown = F.when(~hidden, rounded_percent(F.col(share)))
    cells = performance.select(*by, "partition", task, shown.alias("p"))
    lines = cells.groupBy(*by, "partition").agg(
        F.map_from_entries(F.collect_list(F.struct("task", F.col("p").cast("string")))).alias("shown"),
        F.bround(F.avg(F.col("p").cast("decimal(20,10)")), 1).cast("decimal(6,1)").cast("string").alias("average"),
    )
    all_tasks = F.array(*[F.lit(i) for i in sorted(dims.TASKS.values())])
    row = F.transform(
        all_tasks, lambda t: F.coalesce(F.try_element_at("shown", t), F.lit(dims.MISSING_CELL))
    )
    return lines.select(
        *by,
        "partition",
        F.concat(
            F.lit("L"), F.col("partition").cast("string"), F.lit(" & "),
            F.array_join(row, " & "), F.lit(" & "), F.coalesce("average", F.lit(dims.MISSING_CELL)),
        ).alias("line"),
    )


def csv_rows(performance: DataFrame, by: list[str], share: str, textual: Column) -> DataFrame:
    """A comma line per run over all its levels and tasks; avoided tasks are blank."""
    hidden = textual & F.col("task").isin(KEPT_VISUAL_IDS)
    shown = F.when(hidden, F.lit("")).otherwise(rounded_percent(F.col(share)).cast("string"))
    cell = F.struct("partition", "task", F.coalesce(shown, F.lit("")).alias("p"))
    return performance.groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["p"]), ",").alias("line")
    )


def published_rows(spark: SparkSession) -> DataFrame:
    """Published success rates, one row per (partition, task)."""
    rows = [
        (partition, task, float(rate), dims.PUBLISHED_SEEN)
        for partition, rates in dims.PUBLISHED_SUCCESS.items()
        for task, rate in rates.items()
    ]
    return spark.createDataFrame(rows, "partition int, task int, published double, seen int")


def pending_experiments(models: DataFrame, grid: dict[str, list[str]], done: DataFrame) -> DataFrame:
    """Every combination of a model and the grid's values that has not been run yet."""
    planned = models
    for name, values in grid.items():
        planned = planned.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return planned.join(done, [*models.columns, *grid], "left_anti")


def hidden(mask: Column, off: Column) -> Column:
    """A mask with all of it off where a modality is disabled."""
    return F.transform(mask, lambda m: m & ~off)
