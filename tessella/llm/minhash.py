"""One-permutation MinHash: each shingle is hashed once, the hash's top bits name a bin, the least
hash of a bin is its value, and an empty bin copies the first filled one on a fixed random walk of
bins (optimal densification), the same walk for every document."""

from __future__ import annotations

import numpy as np

from tessella.llm.text import mix64

#: Steps of a walk after which an empty bin takes the first filled one; only sets with very few
#: shingles get there.
STEPS = 192


def walks(bins: int) -> np.ndarray:
    """The bins that an empty bin looks at, in order: bins x STEPS."""
    at = np.arange(bins * STEPS, dtype=np.uint64).reshape(bins, STEPS)
    return (mix64(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int, walk: np.ndarray) -> np.ndarray:
    """Values (rows x bins) of sets given as sorted distinct 64-bit hashes; ``bins`` is a power of
    two. Rows of empty sets are zero."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), bins), np.uint64)
    if not sizes.sum():
        return out
    every = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets)), sizes) * bins + (every >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # hashes are sorted, so the first is the least
    filled = np.zeros(len(sets) * bins, bool)
    filled[cell[first]] = True
    flat = out.reshape(-1)
    flat[cell[first]] = every[first]
    own, filled = out.copy(), filled.reshape(out.shape)
    row, column = np.nonzero(~filled & (sizes > 0)[:, None])
    for step in range(STEPS):
        if not len(row):
            break
        source = walk[column, step]
        hit = filled[row, source]
        out[row[hit], column[hit]] = own[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    if len(row):
        out[row, column] = own[row, filled[row].argmax(1)]
    return out


def low_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits (at most 8) of each bin's value, after it is mixed with the bin's
    number: bins that copy one value would otherwise agree by chance all together."""
    at = np.arange(values.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix64(values + at) & np.uint64((1 << bits) - 1)).astype(np.uint8)
