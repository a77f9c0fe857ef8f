"""Queries of the quality and decontamination operators; SQL has neither classifier nor fingerprints."""

from __future__ import annotations

from episodium.llm import decontaminate, quality
from episodium.llm.registry import query, table


@query("op3_quality_classifier")
def document_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_decontamination")
def benchmark_passages(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
