"""Importing this module registers all queries."""

from episodium.plans import (  # noqa: F401
    action_queries,
    dataset_queries,
    evaluation_queries,
    prompt_queries,
    run_queries,
    scene_queries,
    sequence_queries,
    stream_queries,
)
from episodium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
