"""Importing this module registers the queries of the subpackage."""

from episodium.llm import queries_dups, queries_quality, queries_text, queries_tokens, queries_words  # noqa: F401
from episodium.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
