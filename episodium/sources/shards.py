"""A sharded Parquet data set that is rewritten shard by shard.

Each shard is one file, named ``{split}-{shard}-of-{shards}-{fingerprint}.parquet``; a manifest lists
the files that belong to the data set.  Publishing compares the fingerprints of the rows with those
of the last manifest, writes only shards that differ, to a staging folder, moves their files in place
and then the new manifest, by one rename.  Readers go by the newest manifest, so a publication that
fails at any point changes nothing for them; the next one takes over.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodium.sources.tables import (
    assign_shards,
    read_or_none,
    row_digest,
    shard_decisions,
    shard_manifest,
    shard_name,
)
from episodium.workspace import settle

_MANIFESTS = "_manifests"
_STAGED = re.compile(r"split=([^/]*)/shard=([0-9]+)/part-[^/]*\.parquet$")


class Folder:
    """The files of a folder, in whatever store Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def files_below(self, folder: str) -> list[str]:
        """Paths of all files below a folder, relative to the root."""
        at, found = self._path(f"{self.root}/{folder}"), []
        if self.fs.exists(at):
            files = self.fs.listFiles(at, True)
            while files.hasNext():
                path = files.next().getPath().toString()
                found.append(path[path.index(f"/{folder}/") + 1 :])
        return found

    def make(self) -> None:
        self.fs.mkdirs(self._path(self.root))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def move(self, old: str, new: str) -> None:
        target = self._path(f"{self.root}/{new}")
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self._path(f"{self.root}/{old}"), target):
            raise OSError(f"cannot move {old} to {new}")

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)


def _newest(folder: Folder) -> int:
    """Number of the last committed manifest, 0 if there is none."""
    return max((int(n) for n in folder.names(_MANIFESTS) if n.isdigit()), default=0)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(split, shard, shards, n_rows, fingerprint, file) of the data set, None if there is none yet."""
    newest = _newest(Folder(spark, path))
    return read_or_none(spark, f"{path}/{_MANIFESTS}/{newest}") if newest else None


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the data set, with ``split``; the names are one per shard, read from the manifest."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"{path} has no manifest")
    files = [r["file"] for r in manifest.select("file").collect()]
    rows = spark.read.parquet(*[f"{path}/{name}" for name in files])
    # names of splits have no dash, see publish_shards
    split = F.substring_index(F.substring_index(F.input_file_name(), "/", -1), "-", 1)
    return rows.withColumn("split", split)


def publish_shards(
    rows: DataFrame,
    path: str,
    key: str,
    shards: dict[str, int],
    digest: list[str],
    split: str = "split",
) -> DataFrame:
    """Bring the data set at ``path`` to ``rows`` and return what was done with each shard.

    Rows go to contiguous shards by the unique integer ``key``, ``shards[split]`` of them per split.
    A shard whose row count and fingerprint over the ``digest`` columns are those of the last
    manifest is left alone.  The result has split, shard, shards, decision (skip, write, rewrite or
    drop) and file.  What the driver handles is one name per shard.  One publication at a time: a second one
    that commits meanwhile makes this one fail, and its files stay unseen.
    """
    if any(not re.fullmatch("[A-Za-z0-9_.]+", name) for name in shards):
        raise ValueError("names of splits must be of letters, digits, dots and underscores")
    spark = rows.sparkSession
    folder = Folder(spark, path)
    version = _newest(folder)
    sharded = assign_shards(rows.withColumnRenamed(split, "split"), "split", key, shards)
    by = ["split", "shard"]
    wanted = shard_manifest(sharded.withColumn("shards", F.col("shards").cast("long")), row_digest(*digest), [*by, "shards"])
    name = F.concat(shard_name(F.col("split"), F.col("shard"), F.col("shards"), F.col("fingerprint")), F.lit(".parquet"))
    wanted = settle(wanted.withColumn("file", name), "shard-manifest")
    if not wanted.where("shards IS NULL").isEmpty():
        raise ValueError("rows of a split without a number of shards")
    stored = read_manifest(spark, path)
    if stored is None:
        stored = wanted.limit(0)
    decisions = shard_decisions(stored, wanted, [*by, "shards"])
    files = wanted.select(*by, "shards", "file").unionByName(
        stored.join(wanted, [*by, "shards"], "left_anti").select(*by, "shards", "file")
    )
    done = settle(decisions.join(files, [*by, "shards"]), "shard-decisions")

    changed = done.where(F.col("decision").isin("write", "rewrite")).select(*by, "file")
    staging = f"_staging-{uuid.uuid4().hex}"
    moves = {(r["split"], r["shard"]): r["file"] for r in changed.collect()}
    try:
        if moves:
            held = sharded.join(changed.drop("file"), by, "left_semi").drop("slice", "shards")
            held.repartition("split", "shard").write.partitionBy(*by).parquet(f"{path}/{staging}/data")
            staged = _staged_files(folder, f"{staging}/data")
            if staged.keys() != moves.keys():
                raise RuntimeError("the rows changed while they were published")
            for shard, file in moves.items():
                if folder.exists(file):  # left by a publication that did not commit, or of the same content
                    folder.remove(file)
                folder.move(staged[shard], file)
        wanted.coalesce(1).write.parquet(f"{path}/{staging}/manifest")
        if _newest(folder) != version:
            raise RuntimeError("another publication was committed meanwhile")
        folder.move(f"{staging}/manifest", f"{_MANIFESTS}/{version + 1}")
    finally:
        folder.remove(staging)
    _sweep(folder, {r["file"] for r in wanted.select("file").collect()}, version + 1)
    return done


def _staged_files(folder: Folder, at: str) -> dict[tuple[str, int], str]:
    """The staged file of each shard."""
    found = {}
    for name in folder.files_below(at):
        match = _STAGED.search(name)
        if match:
            found[match[1], int(match[2])] = name
    return found


def _sweep(folder: Folder, wanted: set[str], newest: int) -> None:
    """Remove shard files that the newest manifest does not list, and older manifests."""
    for name in folder.names():
        if name.endswith(".parquet") and name not in wanted:
            folder.remove(name)
    for name in folder.names(_MANIFESTS):
        if name.isdigit() and int(name) < newest:
            folder.remove(f"{_MANIFESTS}/{name}")
