"""Sources and sinks: typed episode tables, shards with a manifest, JSON and CSV results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodium import dims
from episodium.functions.keyed import hash_to_int
from episodium.functions.ranking import contiguous_share, sliced_index
from episodium.workspace import settle

EPISODE_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)


FINGERPRINT_PRIME = (1 << 61) - 1


def episode_path(task_name: Column, idx: Column) -> Column:
    """``task/000123``."""
    return F.concat(task_name, F.lit("/"), F.format_string("%06d", idx))


def list_episodes(episodes: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """Episodes (task_name, idx) with their ``path``; a task is also listed under its old names."""
    if tasks is not None:
        wanted = {dims.TASK_IDS_BY_ANY_NAME[t] for t in tasks}
        names = sorted(name for name, number in dims.TASK_IDS_BY_ANY_NAME.items() if number in wanted)
        episodes = episodes.where(F.col("task_name").isin(names))
    return episodes.withColumn("path", episode_path(F.col("task_name"), F.col("idx")))


def config_name(variant: Column, stage: Column, task_name: Column) -> Column:
    """``variant/stage--task``."""
    return F.concat(variant, F.lit("/"), F.concat_ws("--", stage, task_name))


def write_typed(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """Parquet table partitioned by small columns.

    Rebalancing gathers each partition value and splits the large ones over several tasks.
    """
    rows.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_typed(spark: SparkSession, path: str, schema: T.StructType = EPISODE_SCHEMA) -> DataFrame:
    """Parquet table with an explicit schema; filters on partition columns prune folders."""
    return spark.read.schema(schema).parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_rows(rows: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> None:
    """Add rows to a table partitioned by small columns; they win over stored rows with the same key.

    Only partitions that ``rows`` has rows of are read and written again; ``partition_by`` must
    follow from the keys, so that a key does not move.
    """
    stored = read_or_none(rows.sparkSession, path)
    rows = rows.dropDuplicates(keys)
    if stored is not None:
        touched = rows.select(*partition_by).distinct()
        others = stored.join(touched, partition_by, "left_semi").join(rows.select(*keys), keys, "left_anti")
        rows = settle(rows.unionByName(others, allowMissingColumns=True), "replaced")
    (
        rows.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def ingest(rows: DataFrame, path: str, keys: list[str], replaced_path: str | None = None) -> str:
    """Add rows that are not there yet and return where the table is.

    Running it twice changes nothing.  With ``replaced_path`` the new rows win over stored rows
    with the same key and the merged table is written there; see :func:`replace_rows` for tables
    with partitions.
    """
    stored = read_or_none(rows.sparkSession, path)
    if replaced_path is not None:
        merged = rows
        if stored is not None:
            merged = rows.unionByName(stored.join(rows.select(*keys), keys, "left_anti"))
        merged.write.mode("overwrite").parquet(replaced_path)
        return replaced_path
    fresh = rows if stored is None else rows.join(stored.select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return path


def row_digest(*columns: str) -> Column:
    """60-bit digest of a row, from integer and text columns."""
    return hash_to_int(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 15)


def assign_shards(rows: DataFrame, split: str, key: str, shards: dict[str, int], width: int = 1 << 14) -> DataFrame:
    """Contiguous shard number per split, in key order.

    ``slice`` cuts a shard into runs of ``width`` rows, so that writing it uses many tasks.
    """
    indexed = sliced_index(
        rows, [split], [F.col(key)], [F.floor(F.col(key) / width)], "__i"
    )
    totals = rows.groupBy(split).agg(F.count(F.lit(1)).alias("__total"))  # one row per split
    count = F.try_element_at(
        F.create_map(*[F.lit(x) for item in shards.items() for x in item]), F.col(split)
    )
    return (
        indexed.join(totals, split)
        .withColumn("shard", contiguous_share(F.col("__i"), F.col("__total"), count))
        .withColumn("slice", F.floor(F.col("__i") / width))
        .withColumn("shards", count)
        .drop("__i", "__total")
    )


def shard_manifest(rows: DataFrame, digest: Column, by: list[str]) -> DataFrame:
    """Row count and content fingerprint per shard; partial aggregation does the work.

    The fingerprint adds up the 60-bit digests, modulo 2**61 - 1, so that repeated rows do not cancel.
    """
    digests = (F.sum(digest.cast("decimal(20,0)")) % F.lit(FINGERPRINT_PRIME)).cast("long")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), digests.alias("fingerprint"))


def shard_name(split: Column, shard: Column, shards: Column, fingerprint: Column) -> Column:
    """``train-00003-of-00020-<fingerprint>``."""
    return F.format_string("%s-%05d-of-%05d-%d", split, shard, shards, fingerprint)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per (split, shard), written by as many tasks as the shard has slices."""
    (
        sharded.repartition("split", "shard", "slice")
        .drop("slice", "shards")
        .write.mode("overwrite")
        .partitionBy("split", "shard")
        .parquet(path)
    )


def shard_decisions(stored: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """What to do with each shard: skip, rewrite (drop the stale file first), write or drop."""
    content = F.struct("n_rows", "fingerprint")
    old = stored.select(*by, content.alias("old"))
    new = wanted.select(*by, content.alias("new"))
    decision = (
        F.when(F.col("new").isNull(), F.lit("drop"))
        .when(F.col("old").isNull(), F.lit("write"))
        .when(F.col("old") == F.col("new"), F.lit("skip"))
        .otherwise(F.lit("rewrite"))
    )
    return old.join(new, by, "full").select(*by, decision.alias("decision"))


def read_split_folders(spark: SparkSession, root: str, pattern: str = r"/(train|valid)[^/]*/[^/]*$") -> DataFrame:
    """All Parquet files below a folder, with the split named by their folder."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(root)
    return rows.withColumn("split", F.regexp_extract(F.input_file_name(), pattern, 1))


def column_major(rows: DataFrame, columns: list[str], document: Column) -> DataFrame:
    """``{"columns": […], "data": [[…]]}`` documents; ``document`` must keep documents small."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    return (
        rows.withColumn("document", document)
        .groupBy("document")
        .agg(F.collect_list(cells).alias("data"))
        .select(
            "document",
            F.to_json(
                F.struct(F.array(*[F.lit(c) for c in columns]).alias("columns"), "data")
            ).alias("json"),
        )
    )


def parse_column_major(documents: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows of column-major JSON documents; columns are found by name and cast."""
    parsed = documents.select(
        F.from_json("json", "struct<columns:array<string>,data:array<array<string>>>").alias("d")
    )
    cell = lambda name: F.get(
        F.col("row"), (F.array_position(F.col("columns"), F.lit(name)) - 1).cast("int")
    )
    return parsed.select(F.col("d.columns").alias("columns"), F.explode("d.data").alias("row")).select(
        *[cell(name).cast(kind).alias(name) for name, kind in wanted.items()]
    )


def read_result_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result CSV in which the word ``null`` stands for a missing value."""
    return (
        spark.read.option("header", "true")
        .option("nullValue", "null")
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(path)
    )


def write_json_lines(rows: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines, one folder per split."""
    rows.hint("rebalance", by).write.mode("overwrite").partitionBy(by).json(path)


def checkpoint_for_epoch(listing: DataFrame, requests: DataFrame) -> DataFrame:
    """Checkpoint file per requested epoch of a run; NULL when there is none.

    Only names with ``epoch=`` count.  A negative epoch means the number of such files less one.
    """
    named = listing.where(F.contains("file", F.lit("epoch="))).select(
        "run", "file", F.regexp_extract("file", r"epoch=(\d{2,})", 1).alias("found")
    )
    counts = named.groupBy("run").agg(F.count(F.lit(1)).alias("files"))
    epoch = F.when(F.col("epoch") < 0, F.coalesce("files", F.lit(0)) - 1).otherwise(F.col("epoch"))
    asked = (
        requests.join(counts, "run", "left")
        .withColumn("wanted_epoch", epoch)
        .withColumn("tag", F.format_string("%02d", "wanted_epoch"))
    )
    found = named.select("run", F.col("found").alias("tag"), "file")
    return asked.join(found, ["run", "tag"], "left").groupBy("run", "epoch", "wanted_epoch").agg(
        F.min("file").alias("file")
    )


def save_episodes(headers: DataFrame, actions: DataFrame, observations: DataFrame, path: str) -> DataFrame:
    """Write header and step tables of complete episodes; return all headers with ``accepted``.

    An episode is complete if it has one observation more than actions.
    """
    acted = actions.groupBy("idx").agg(F.count(F.lit(1)).alias("n_actions"))
    seen = observations.groupBy("idx").agg(F.count(F.lit(1)).alias("n_obs"))
    checked = (
        headers.join(acted, "idx", "left")
        .join(seen, "idx", "left")
        .withColumn(
            "accepted",
            F.coalesce("n_obs", F.lit(0)) == F.coalesce("n_actions", F.lit(0)) + 1,
        )
        .withColumn("failure", ~F.col("success"))
    )
    good = checked.where(F.col("accepted")).drop("accepted")
    write_typed(good, path + "/headers", ["task"])
    write_typed(actions.join(good.select("idx", "task"), "idx"), path + "/steps", ["task"])
    return checked
