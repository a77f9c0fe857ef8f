"""Positions and shares: exact, and independent of how a group is cut."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from episodium.functions import ranking


def rows(spark, n=500):
    # group 0 holds well over a third of all rows
    return spark.range(n).select(
        "id", F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 37 % 101).alias("v")
    )


def expected(frame):
    groups = {}
    for r in frame.collect():
        groups.setdefault(r["g"], []).append((r["v"], r["id"]))
    return {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g))}


def found(frame, name="t"):
    return {r["id"]: r[name] for r in frame.collect()}


def test_sliced_index_equals_window(spark):
    frame = rows(spark)
    order = [F.col("v"), F.col("id")]
    got = ranking.sliced_index(frame, ["g"], order, [F.floor(F.col("v") / 10)])
    assert found(got) == expected(frame)


def test_running_index(spark):
    frame = rows(spark)
    assert found(ranking.running_index(frame, ["g"], [F.col("v"), F.col("id")])) == expected(frame)


def test_sliced_index_keeps_null_groups(spark):
    frame = rows(spark).withColumn("g", F.when(F.col("g") != 3, F.col("g")))
    got = ranking.sliced_index(frame, ["g"], [F.col("v"), F.col("id")], [F.floor(F.col("v") / 10)])
    assert found(got) == {**expected(frame)}


def test_dense_index_over_gaps(spark):
    frame = spark.range(300).select((F.col("id") * F.col("id")).alias("id"))
    assert found(ranking.dense_index(frame, "id"), "i") == {i * i: i for i in range(300)}


def test_dense_index_of_hashed_and_text_keys(spark):
    frame = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    for key in ("id", "s"):
        got = sorted((r[key], r["i"]) for r in ranking.dense_index(frame.repartition(5), key).collect())
        assert [i for _, i in got] == list(range(20_000))
    assert ranking.dense_index(frame.limit(0), "id").count() == 0


def test_hash_index_is_a_permutation(spark):
    frame = rows(spark).withColumn("h", F.md5(F.col("id").cast("string")))
    got = ranking.hash_index(frame, ["g"], "h", ["id"], digits=1)
    by_group = {}
    for r in got.collect():
        by_group.setdefault(r["g"], []).append((r["t"], r["h"]))
    for items in by_group.values():
        items.sort()
        assert [t for t, _ in items] == list(range(len(items)))
        assert [h for _, h in items] == sorted(h for _, h in items)


@settings(max_examples=5, deadline=None)
@given(total=st.integers(1, 60), parts=st.integers(1, 12))
def test_contiguous_share(spark, total, parts):
    got = spark.range(total).select(
        ranking.contiguous_share(F.col("id"), F.lit(total), parts).alias("p")
    )
    shares = [r["p"] for r in got.collect()]
    assert shares == sorted(shares)
    sizes = [shares.count(p) for p in range(parts)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
