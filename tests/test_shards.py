"""Publishing shards: names, what is rewritten, and failures."""

import os

import pytest
from pyspark.sql import functions as F

from episodium.sources import shards
from episodium.sources import tables as io

NUMBERS = {"train": 4, "valid": 2}


def rows(spark, changed=-1):
    return spark.range(600).select(
        F.col("id").alias("idx"),
        F.when(F.col("id") % 6 == 0, "valid").otherwise("train").alias("split"),
        F.when(F.col("id") == changed, "other").otherwise(F.concat(F.lit("row "), F.col("id"))).alias("text"),
    )


def publish(frame, path, numbers=NUMBERS):
    return {(r["split"], r["shard"], r["shards"]): r for r in shards.publish_shards(frame, path, "idx", numbers, ["idx", "text"]).collect()}


def files(path):
    return {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path) if n.endswith(".parquet")}


def test_one_changed_shard_rewrites_one_file(spark, tmp_path):
    path = str(tmp_path / "set")
    first = publish(rows(spark), path)
    assert {r["decision"] for r in first.values()} == {"write"} and len(first) == 6
    before = files(path)
    assert set(before) == {r["file"] for r in first.values()}
    assert all(n.startswith(("train-0000", "valid-0000")) and ("-of-00004-" in n or "-of-00002-" in n) for n in before)
    assert {r["decision"] for r in publish(rows(spark), path).values()} == {"skip"}
    assert files(path) == before

    done = publish(rows(spark, changed=7), path)
    assert {k for k, r in done.items() if r["decision"] == "rewrite"} == {("train", 0, 4)}
    after = files(path)
    assert len(after) == 6 and len(set(after) & set(before)) == 5
    assert all(after[n] == before[n] for n in set(after) & set(before))
    got = {(r["idx"], r["split"], r["text"]) for r in shards.read_shards(spark, path).collect()}
    assert got == {(r["idx"], r["split"], r["text"]) for r in rows(spark, changed=7).collect()}
    # nothing of the staging is left, one manifest is
    assert {n for n in os.listdir(path) if n[0] != "."} - set(after) == {"_manifests"}
    assert [n for n in os.listdir(f"{path}/_manifests") if n.isdigit()] == ["3"]


def test_shards_that_are_gone_are_dropped(spark, tmp_path):
    path = str(tmp_path / "set")
    publish(rows(spark), path)
    done = publish(rows(spark).where("split = 'train'"), path)
    assert {k for k, r in done.items() if r["decision"] == "drop"} == {("valid", 0, 2), ("valid", 1, 2)}
    assert len(files(path)) == 4 and shards.read_shards(spark, path).count() == 500
    fewer = publish(rows(spark).where("split = 'train'"), path, {"train": 2})
    assert sum(r["decision"] == "write" for r in fewer.values()) == 2 and len(files(path)) == 2


def test_a_failed_publication_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    publish(rows(spark), path)
    before = files(path)
    broken = rows(spark, changed=7).withColumn("more", F.when(F.col("idx") == 7, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        publish(broken, path)
    assert files(path) == before

    # the driver ends after some files are moved: readers still go by the old manifest
    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(shards, "_newest", lambda f, real=shards._newest, calls=[]: die() if len(calls) == 2 else (calls.append(1), real(f))[1])
    with pytest.raises(KeyboardInterrupt):
        publish(rows(spark, changed=7), path)
    monkeypatch.undo()
    assert {r["text"] for r in shards.read_shards(spark, path).collect()} == {r["text"] for r in rows(spark).collect()}
    publish(rows(spark, changed=7), path)
    assert len(files(path)) == 6 and shards.read_shards(spark, path).where("text = 'other'").count() == 1


def test_unknown_splits_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="without a number"):
        publish(rows(spark), str(tmp_path / "a"), {"train": 2})
    with pytest.raises(ValueError, match="names"):
        publish(rows(spark), str(tmp_path / "b"), {"a/b": 2})


def test_replaced_rows_leave_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 4).alias("p"), F.lit("old").alias("v"))
    io.replace_rows(frame, path, ["k"], ["p"])
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("p=")}
    fresh = spark.createDataFrame([(1, 1, "new"), (1, 1, "new"), (101, 1, "new")], "k bigint, p bigint, v string")
    io.replace_rows(fresh, path, ["k"], ["p"])
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("p=")}
    assert {d for d in after if after[d] != before[d]} == {"p=1"}
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {**{k: "old" for k in range(100)}, 1: "new", 101: "new"}
