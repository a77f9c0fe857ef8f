"""Where jobs keep tables they must write and read back.

A cluster names its shared folder in ``spark.checkpoint.dir``; only a local session (tests, bench)
may fall back to a folder of this machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local_root: str | None = None
#: Folders that this process made and did not remove, in order.
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; raises on a cluster that names none."""
    global _local_root
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="episodium-")
    return _local_root


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other job uses."""
    path = f"{shared_root(spark)}/episodium/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def settle(rows: DataFrame, purpose: str = "settled") -> DataFrame:
    """The rows as a written table, for results that several steps read.

    Cuts the lineage; a lost executor costs a re-read, not a recomputation.  The folder may go once
    the job that asked for it is done, see :func:`step`.
    """
    path = new_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, in whatever store Spark can reach; nothing happens if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def step(spark: SparkSession, rows: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """The rows of a step of a long job, settled; every other folder that the step made is removed.

    ``rows`` is called here, so that the folders it needs are known; they must not be needed later.
    """
    before = len(_made)
    result = settle(rows(), purpose)
    mine, _made[before:] = _made[before:-1], _made[-1:]
    for path in mine:
        discard(spark, path)
    return result
