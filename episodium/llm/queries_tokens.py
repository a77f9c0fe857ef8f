"""Queries of the packing operators; SQL has no tokenizer, so they have no twin."""

from __future__ import annotations

import public_tokenizers

from episodium.llm import packing, retrieval_packing
from episodium.llm.registry import query, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op4_retrieval_packing")
def packed_by_retrieval(spark, sf_dir):
    return retrieval_packing.pack_by_retrieval(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op8_token_output")
def token_output(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
