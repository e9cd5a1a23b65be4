"""Words of text columns as 64-bit hashes, without Python objects for them."""

from __future__ import annotations

import numpy as np

from gleaner.llm.shared import SPACE_BYTES

_MASK = (1 << 64) - 1
_SPACE = np.isin(np.arange(256), SPACE_BYTES)


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    return x ^ x >> 31


#: A number for each byte; A-Z have those of a-z.
_BYTE = np.array([_mixed(b + 32 if 65 <= b <= 90 else b) for b in range(256)], np.uint64)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads its input."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    if n:
        x[0] = 1
    return np.multiply.accumulate(x) if n else x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the n + 1 places where each text's words begin."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = solid[heads]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    tails = heads - 1
    tails = np.append(tails[tails >= 0], len(data) - 1) if len(data) else tails
    ends[tails] = solid[tails]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    hashes = (total[last + 1] - total[first]) * _powers(_INVERSE, len(data))[first] if len(first) else np.zeros(0, np.uint64)
    return mix(hashes + (last - first + 1).astype(np.uint64)), np.searchsorted(first, offsets)
