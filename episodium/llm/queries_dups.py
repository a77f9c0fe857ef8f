"""Query of the Jaccard join; it is tested against all pairs in Python, and has no SQL twin."""

from __future__ import annotations

from episodium.llm import jaccard_join
from episodium.llm.registry import query, table


@query("op2_jaccard_join")
def near_duplicates(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
