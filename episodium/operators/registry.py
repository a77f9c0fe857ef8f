"""Prompt transforms by name, so that a configuration can say which to apply.

A configuration is a list of entries ``{"name": ..., parameters ...}``, applied one after the other.
Names, parameters and the columns each transform reads are checked before a job starts.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodium.operators import prompts as pr
from episodium.vocabulary import SLOTS, TEMPLATES, TEXTUAL_TEMPLATES


@dataclass(frozen=True)
class Entry:
    """How a named transform is made, and which columns it reads, takes away and adds."""

    make: Callable[..., pr.Transform]
    reads: frozenset[str]
    drops: frozenset[str] = frozenset()
    adds: frozenset[str] = frozenset()


_ENTRIES: dict[str, Entry] = {}


def register(name: str, reads: Sequence[str], drops: Sequence[str] = (), adds: Sequence[str] = ()):
    """Make a function of parameters that returns a transform known under ``name``."""

    def keep(make: Callable[..., pr.Transform]) -> Callable[..., pr.Transform]:
        if name in _ENTRIES:
            raise ValueError(f"{name} is registered already")
        _ENTRIES[name] = Entry(make, frozenset(reads), frozenset(drops), frozenset(adds))
        return make

    return keep


def names() -> list[str]:
    """Every registered name."""
    return sorted(_ENTRIES)


def build(config: Sequence[Mapping[str, object]], columns: Sequence[str] | None = None) -> pr.Transform:
    """The chain that a configuration describes.

    Unknown names, missing or unknown parameters, and, with ``columns``, columns that a transform
    reads but would not find at its place in the chain, raise a ValueError.
    """
    chain, found = [], None if columns is None else set(columns)
    for place, entry in enumerate(config):
        parameters = dict(entry)
        name = parameters.pop("name", None)
        if name not in _ENTRIES:
            raise ValueError(f"transform {place}: {name!r} is not one of {', '.join(names())}")
        known = _ENTRIES[name]
        try:
            inspect.signature(known.make).bind(**parameters)
        except TypeError as error:
            raise ValueError(f"transform {place}, {name}: {error}") from None
        if found is not None:
            missing = sorted(known.reads - found)
            if missing:
                raise ValueError(f"transform {place}, {name}: no column {', '.join(missing)}")
            found = (found - known.drops) | known.adds
        chain.append(known.make(**parameters))
    return pr.chain(*chain)


def apply(rows: DataFrame, config: Sequence[Mapping[str, object]]) -> DataFrame:
    """``rows`` through the configured chain, checked against their columns first."""
    return rows.transform(build(config, rows.columns))


@register("noop", [])
def _noop() -> pr.Transform:
    return pr.noop


@register("nonsense_words", ["idx", "prompt"])
def _nonsense_words(seed: object) -> pr.Transform:
    return pr.nonsense_words(seed)


@register("nonsense_tokens", ["idx", "prompt"])
def _nonsense_tokens(vocabulary: DataFrame, seed: object) -> pr.Transform:
    return pr.nonsense_tokens(vocabulary, seed)


@register("reword", ["idx", "task", "prompt"], adds=["status"])
def _reword(seed: object, allow_original: bool = True, textures: Sequence[str] = ()) -> pr.Transform:
    sets = pr.template_sets(TEMPLATES, SLOTS)
    names_ = F.array(*[F.col(c) for c in textures]) if textures else None
    return lambda rows: pr.reword(rows, sets, seed, names_, allow_original)


@register("textual", ["idx", "task", "prompt", "assets"], adds=["status"])
def _textual(seed: object, mode: str | None = None) -> pr.Transform:
    if mode not in (None, "underspecify_nouns", "remove_textures", "remove_nouns"):
        raise ValueError(f"unknown mode {mode!r}")
    sets = pr.template_sets(TEXTUAL_TEMPLATES, {t: SLOTS[t] for t in TEXTUAL_TEMPLATES})
    return pr.textual(sets, seed, mode)


@register("other_instruction", ["idx", "task", "prompt", "assets"], adds=["status"])
def _other_instruction(seed: object) -> pr.Transform:
    return pr.other_instruction(seed)
