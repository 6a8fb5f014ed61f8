"""Rank files of byte-level BPE vocabularies and the pattern that splits text before the merges."""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np

#: Folder of the public vocabularies; every operator takes the path as a parameter.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with Path(path).open("rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(4)
def token_sizes(path: str) -> np.ndarray:
    """Bytes of the token of each id."""
    out = np.zeros(max(ranks(path).values()) + 1, np.int64)
    for token, i in ranks(path).items():
        out[i] = len(token)
    return out


@functools.lru_cache(4)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
