"""Words and 64-bit hashes of whole Arrow batches of texts, on their UTF-8 bytes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at once, unless a single text is longer.
BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_GENERATOR = np.random.default_rng(20240607)
_BYTE = _GENERATOR.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes lie outside all of the closed ``ranges``."""
    inside = np.ones(256, bool)
    for low, high in ranges:
        inside[low : high + 1] = False
    return inside


#: Bytes of words: all but white space; letters, digits and non-ASCII only.
NOT_SPACE = table((0x20, 0x20), (0x09, 0x0D))
ALNUM = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins and ends; null is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive texts of about ``limit`` bytes."""
    data, offsets = utf8(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes; the words of text i are bounds[i]:bounds[i + 1]."""
    mask = inside[data]
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    filled = np.flatnonzero(np.diff(offsets))
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    start[first], end[last] = mask[first], mask[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`spans` hashes any span of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes hash alike wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64) * _ODD)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending disjoint spans, in blocks, so that memory follows BLOCK and the longest span."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        sums = prefix_sums(data[base : ends[high - 1]])
        out[low:high] = spans(sums, starts[low:high] - base, ends[low:high] - base)
        low = high
    return out


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, order kept."""
    h = np.full(len(parts[0]), _ODD, np.uint64)
    for part in parts:
        h = mix(h * np.uint64(_BASE) + part)
    return h
