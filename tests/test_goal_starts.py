"""Goals are folded from one state in an episode's first slice."""

from pyspark.sql import functions as F

from episodium.operators import goals as go


def test_first_slice_is_folded_once(spark, monkeypatch):
    monkeypatch.setattr(go, "SLICE_STEPS", 4)
    steps = spark.createDataFrame([(1, t, t % 3) for t in range(11)] + [(2, 0, 2)], "idx bigint, t bigint, kind int")
    rounds = [F.col("kind") == k for k in (1, 0, 2)]
    done = go.follow_goals(steps, rounds)
    got = {r["idx"]: (r["times"], r["goals_done"], r["violated_at"]) for r in done.collect()}
    assert got == {1: ([1, 3, 5], 3, 0), 2: ([], 0, None)}
    assert "CASE WHEN (slice" in done._jdf.queryExecution().analyzed().toString()
