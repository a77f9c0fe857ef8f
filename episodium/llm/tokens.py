"""Token ids by a byte-level BPE vocabulary file, for use inside tasks."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: The pattern that byte-level BPE cuts texts by before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in such a file: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """An encoder for the file, made once in a worker.

    The file's added tokens have their ids wherever a text holds them.  The merges of such a file are
    in the order of their ids, which lets ``tiktoken`` apply them; it gives the ids of ``tokenizers``.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path} is no byte-level BPE vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or spec["normalizer"]:
        raise ValueError(f"{path} has added tokens that take in what is around them, or a normalizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    chars = _byte_of_char()
    ranks = {bytes(chars[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def _slow_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(text: str, path: str) -> np.ndarray:
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        # a run of blanks too long for the pattern's stack
        return np.array(_slow_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)


def encode(texts: Sequence[str | None], path: str, end_id: int | None) -> list[np.ndarray]:
    """The ids of each text as unsigned 32-bit numbers, followed by ``end_id``; null is empty."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    return [np.concatenate([_ids(text or "", path), tail]) for text in texts]
