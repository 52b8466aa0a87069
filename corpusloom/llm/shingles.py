"""Sets of word shingles of whole batches of texts, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytehash import BASE, mix, part_hashes
from .words import text_bytes, word_spans

#: Each byte, or its small letter.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bits of a set's parities.
PARITIES = 256


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the ascending hashes of its distinct shingles of k words, A-Z lower-cased.

    A text with fewer words has its whole sequence as the only one; one without words, or null, has none.
    """
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        yield from (np.zeros(0, np.uint64) for _ in range(len(texts)))
        return
    words = part_hashes(_FOLD[data], starts, ends)
    value = np.zeros(len(words), np.uint64)
    for i in range(min(k, len(words))):  # with fewer words in all, no text has a shingle of k
        value[: len(words) - i] = (value[: len(words) - i] + words[i:]) * BASE
        value[: len(words) - i] ^= value[: len(words) - i] >> np.uint64(32)
    value = mix(value)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            found = np.sort(value[a : b - k + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif b > a:  # a hash that depends on the number of words too
            yield mix(np.array([sum(int(w) * pow(3, i + 1) for i, w in enumerate(words[a:b])) + int(b - a) & (1 << 64) - 1], np.uint64) * BASE)
        else:
            yield np.zeros(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit number that equal sets share."""
    total = int(mix(hashes).sum(dtype=np.uint64)) + len(hashes) * int(BASE) & (1 << 64) - 1
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of PARITIES classes of tokens whether a set has an odd number of them, as four signed 64-bit numbers.

    Two sets differ by at least as many tokens as they differ in such bits, as each token that only one has turns one bit.
    """
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.intp), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)
