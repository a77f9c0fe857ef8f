"""Whole instances: steps are dealt once, words stay with their prompt."""

from pyspark.sql import functions as F

from episodium.operators import preprocess
from episodium.operators import prompts as pr
from episodium.plans import catalogue


def test_steps_are_dealt_once_and_words_not_at_all(spark, folder):
    whole = catalogue.QUERIES["m11_whole_instances"](spark, folder)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert "Exchange hashpartitioning(token" not in plan
    # headers, words and images, each dealt by episode from the written prompts, and no more than that
    assert plan.count("Exchange hashpartitioning(idx") == 3


def test_a_vocabulary_of_few_words_is_broadcast_with_the_same_ids(spark, monkeypatch):
    tokens = spark.createDataFrame([(i, p, w) for i in range(9) for p, w in enumerate(["a", "b", "a", "zz", None])], "idx long, pos int, token string")
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, token_id long")
    rows = lambda few: sorted(map(str, pr.encode(tokens, words, few=few).select("idx", "pos", "token", "token_id").collect()))
    assert rows(True) == rows(False) and len(rows(True)) == 45
    assert pr.few_words(words) and pr.few_words(words.limit(0))
    monkeypatch.setattr(pr, "VOCABULARY_BYTES", 3 * pr.WORD_BYTES)
    assert not pr.few_words(words)


def test_steps_gathered_once_equal_steps_gathered_twice(spark):
    axes = [F.col("t").cast("double").alias(a) if a != "p0x" else (F.col("t") * 2.0).alias(a) for a in preprocess.AXES]
    view = "array<struct<view string>>"
    seen = spark.createDataFrame([(1, 1, "ok"), (1, 0, "ok"), (2, 0, "broken")], "idx long, t long, status string")
    seen = seen.select("*", F.array(F.struct(F.lit("top").alias("view"))).alias("views"), *axes)
    headers = spark.createDataFrame([(1, 3, "suction"), (2, 4, "spatula"), (5, 6, "suction")], "idx long, task int, end_effector string")
    tokens = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 1, None)], "idx long, pos int, type int, token_id long")
    images = spark.createDataFrame([], f"idx long, pos int, views {view.replace('view string', 'view:string')}, status string")
    poses = seen.select("idx", "t", *preprocess.AXES)
    once = preprocess.preprocess(headers, tokens, images, seen, seen)
    twice = preprocess.preprocess(headers, tokens, images, seen, poses)
    found = [sorted(map(str, f.collect())) for f in (once, twice)]
    assert found[0] == found[1] and len(found[0]) == 3
    assert [r["status"] for r in once.orderBy("idx").collect()] == ["ok", "broken", "ok"]
