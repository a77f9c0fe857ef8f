"""Rewording writes only templates that may spell the original, and no template is copied per row."""

from pyspark.sql import functions as F

from episodium import dims
from episodium import vocabulary as V
from episodium.operators import prompts as pr
from episodium.plans import prompt_queries as pq


def test_templates_that_are_ruled_out_differ(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    quick = pq.t7_different(spark, folder).orderBy("idx").collect()
    calls = []
    monkeypatch.setattr(pr, "may_be", lambda *_: calls.append(1) or F.lit(True))
    assert pq.t7_different(spark, folder).orderBy("idx").collect() == quick and calls


def test_few_templates_are_written(spark):
    rows = pq.known_slots(spark, "/root/testdata/sf0.001").where("matched IS NOT NULL")
    drawn = lambda p: pr.picked_word(p, "match-words", F.col("idx"))
    sets = pq.reword_sets()
    left = F.size(F.filter(sets, lambda t: pr.may_be(t, F.lower("prompt"), drawn)))
    got = rows.agg(F.sum(left).alias("left"), F.sum(F.size(sets)).alias("all")).first()
    assert 0 < got["left"] < got["all"] / 4


def test_odd_words_rule_nothing_out(spark):
    # words that sentence case or the joining of spaces may change are not looked for
    templates = {"rotate": ["{w}  A {x} b", "Turn {w} {x}"]}
    slots = {"rotate": {"w": [" up", "DOWN"], "x": ["İΣ"]}}
    parts = pr.template_parts(0, templates["rotate"][0], slots["rotate"])
    assert parts["fixed"] == "a" and parts["telling"] is None
    rows = spark.range(40).select(F.col("id").alias("idx"), F.lit(dims.TASKS["rotate"]).alias("task"))
    sets = pr.template_sets(templates, slots)
    drawn = lambda p: pr.picked_word(p, "s", F.col("idx"))
    text = lambda t: F.lower(pr.X.sentence(pr.written(t, drawn)))
    own = F.transform(sets, lambda t: pr.may_be(t, text(t), drawn))
    assert rows.where(F.exists(own, lambda found: ~found)).count() == 0


def test_drawn_numbers_leave_no_templates_behind(spark):
    rows = spark.range(1).select(F.col("id").alias("idx"), F.lit(0).alias("task"))
    number = pr.keyed_number(pr.template_sets(V.TEMPLATES, V.SLOTS), "s", F.col("idx"))
    plan = rows.select(number.alias("n"))._jdf.queryExecution().analyzed().toString()
    assert ".no AS n" not in plan
