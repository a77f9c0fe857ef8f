"""Draws by lots: every template, word and place has a digest of its own."""

import hashlib

import pytest
from pyspark.sql import functions as F

from episodium.functions import text as X
from episodium.operators import prompts as pr
from episodium.plans import catalogue


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def test_the_template_with_the_least_digest_is_drawn(spark):
    templates = F.array(*[F.struct(F.lit(n).alias("no")) for n in (3, 5, 8, 9)])
    got = {r[0]: r[1] for r in spark.range(40).select("id", pr.least_number(templates, "s", F.col("id"))).collect()}
    assert got == {i: min((3, 5, 8, 9), key=lambda n: digest("s", i, n)) for i in range(40)}


def test_places_are_ordered_by_whole_digests(spark):
    items = [f"w{i}" for i in range(60)]
    moved = X.shuffle_unlocked(F.array(*[F.lit(w) for w in items]), lambda w: F.lit(True), "s", F.col("id"), apart=True)
    got = spark.range(1).select(moved).first()[0]
    assert got == [items[i] for i in sorted(range(60), key=lambda i: digest("s", 0, i))]


@pytest.mark.parametrize("name", ["t14_generated_prompts", "t6_prompt_validity", "t2_nonsense_words", "t1_chained_transforms", "t3_nonsense_tokens", "t10_textual"])
def test_queries_draw_by_lots(name):
    sql = catalogue.ORACLES[name]
    assert "ORDER BY md5(concat_ws('|', 'prompt'," in sql
    assert "sha256" not in sql
