"""Incremental twins of the batch metrics."""
