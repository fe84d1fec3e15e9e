"""Variable-byte integers: seven bits a byte, highest group first; every byte but the first of a value has its top bit set."""

from __future__ import annotations

import numpy as np


def lengths(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), dtype=np.int64)
    rest = values.astype(np.uint64) >> np.uint64(7)
    while rest.any():
        out += rest > 0
        rest = rest >> np.uint64(7)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values in a row, length of each)."""
    size = lengths(values)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    rest = values.astype(np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        at = size > k
        top = np.where(size[at] == k + 1, 0, 128).astype(np.uint8)
        out[ends[at] - 1 - k] = (rest[at] & np.uint64(127)).astype(np.uint8) | top
        rest = rest >> np.uint64(7)
    return out, size


def decode(data: np.ndarray) -> np.ndarray:
    """The values of a run of bytes that begins with a value's first byte."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    first = data < 128
    value = np.cumsum(first) - 1
    ends = np.append(np.flatnonzero(first)[1:], len(data))
    shift = (ends[value] - 1 - np.arange(len(data))) * 7
    out = np.zeros(int(value[-1]) + 1, dtype=np.uint64)
    np.bitwise_or.at(out, value, (data & 127).astype(np.uint64) << shift.astype(np.uint64))
    return out.astype(np.int64)
