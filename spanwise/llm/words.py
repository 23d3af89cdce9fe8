"""Hashes of the words and word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
# So many bytes are hashed at a time; a longer text is cut between words.
CHUNK = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * STEP)[LOWER]


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the given stretches of ``data``, letters in lower case."""
    if not len(starts):
        return np.empty(0, U)
    powers = np.cumprod(np.full(int(sizes.max()), STEP | U(1), U))
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    values = BYTES[data[place + np.repeat(starts, sizes)]] * powers[place]
    return mix(np.add.reduceat(values, firsts) + sizes.astype(U))


def words(texts: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and size in bytes of each word of the non-null ``texts``, and where each text's words end."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.empty(0, U), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    inside = ~separators[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | breaks[:-1]))
    after = np.concatenate([inside[1:], [False]])
    sizes = np.flatnonzero(inside & (~after | breaks[1:])) + 1 - starts
    cuts = np.searchsorted(starts, np.arange(0, len(data) + CHUNK, CHUNK))
    found = [_hashes(data, starts[a:b], sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate(found), sizes, np.searchsorted(starts, bounds[1:])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on where so many follow."""
    if len(hashes) < n:
        return np.empty(0, U)
    total = np.zeros(len(hashes) - n + 1, U)
    for i in range(n):
        total = total * U(0xD1342543DE82EF95) + hashes[i : len(hashes) - n + 1 + i]
    return mix(total + U(n * int(STEP) % (1 << 64)))
