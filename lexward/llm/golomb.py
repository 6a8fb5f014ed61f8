"""Golomb-Rice coding of ascending integers, over numpy arrays."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQ")


def encode(values: np.ndarray) -> bytes:
    """Code ascending non-negative int64 values (repeats allowed).

    The gaps are split at a power of two near their mean: first all quotients in unary, then all remainders
    in fixed width.
    """
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values, prepend=0).astype(np.int64)
    mean = int(values[-1]) // n
    width = max(mean.bit_length() - 1, 0)
    ends = np.cumsum((gaps >> width) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = (gaps & ((1 << width) - 1)).astype(">u8")
    bits = np.unpackbits(low.view(np.uint8).reshape(n, 8), axis=1)[:, 64 - width :]
    return _HEAD.pack(n, width, len(unary)) + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def decode(blob: bytes) -> np.ndarray:
    """The values that encode() was given."""
    n, width, length = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(0, np.int64)
    split = _HEAD.size + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, split - _HEAD.size, _HEAD.size), count=length))
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, split), count=n * width).reshape(n, width)
    full = np.zeros((n, 64), np.uint8)
    full[:, 64 - width :] = bits
    low = np.packbits(full, axis=1).view(">u8")[:, 0].astype(np.int64)
    return np.cumsum((quotients.astype(np.int64) << width) + low)
