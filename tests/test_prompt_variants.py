"""Lengths of prompts and of their nonsense forms come from prompts that are written once."""

from pyspark.sql import functions as F

from episodium.operators import prompts as pr
from episodium.plans import prompt_queries as pq


def test_prompts_are_written_once(spark):
    plan = pq.a9(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_pieces_are_counted_as_they_are_made(spark):
    words = ["", "a", "four", "fives", "eightlet", "nineletts", "{dragged_obj_1}", "\u00e9\u00e9\u00e9\u00e9\U0001F600"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select(pr.n_pieces(F.col("w")).alias("n"), F.size(pr.pieces(F.col("w"))).alias("made")).collect()
    assert [r["n"] for r in got] == [r["made"] for r in got] == [0, 1, 1, 2, 2, 3, 1, 2]
