"""Hashes of parts of byte strings, computed for whole batches by numpy."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer parts are hashed one by one.
MOST_BYTES = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which all bits of a result depend on all bits of its argument."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_table(seed: int) -> np.ndarray:
    """A pseudorandom number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE + np.uint64(seed))


def part_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the parts [start, end) of data; equal parts have equal hashes wherever they stand.

    Eight bytes at a time go through mix() together with the hash of what came before, so that no sum over the bytes decides.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    value = mix(left.astype(np.uint64) * BASE)
    long = np.flatnonzero(left > MOST_BYTES)
    value[long] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    some = np.flatnonzero((left > 0) & (left <= MOST_BYTES))
    at, left = starts[some], left[some]
    while len(some):
        lane = lanes[at]
        unused = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        value[some] = mix(value[some] ^ ((lane << unused) >> unused))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return value
