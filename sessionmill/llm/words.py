"""Words and word shingles of whole Arrow batches as 64-bit hashes, by a running polynomial hash.

A word is a run of letters and digits after lower-casing; every character beyond ASCII counts as a
letter. The hash of a span comes from prefix sums of byte * base^position, so a batch needs no loop over
words. All values are modulo 2^64 and are mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse for i up to n, kept for reuse; very long ones are not."""
    size = max(_SEGMENT + 1, n + 1)
    if size in _powers:
        return _powers[size]
    inverse = pow(_BASE, -1, 1 << 64)
    pair = tuple(
        np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, base, dtype=np.uint64))]).astype(np.uint64) for base in (_BASE, inverse)
    )
    if size == _SEGMENT + 1:
        _powers[size] = pair
    return pair


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_slices(texts: pa.Array, limit: int = _SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together, so that what is derived from them stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, stop
        at = stop


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each text where its words begin (one more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    hashes, begins, total = [], [np.zeros(1, dtype=np.int64)], 0
    for first, stop in text_slices(texts):
        some, places = _words(pc.utf8_lower(texts.slice(first, stop - first)))
        hashes.append(some)
        begins.append(places[1:] + total)
        total += len(some)
    return np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]), np.concatenate(begins)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)  # between bytes: a text ends or begins
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # segments of whole words
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT, side="right")))
        sums = prefix_sums(raw[low : ends[stop - 1]])
        hashes[at:stop] = span_hashes(sums, starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    up, _ = powers(size)
    for j in range(size):
        total += words[j : j + n] * up[j + 1]
    return mix(total)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles; a text with fewer words has one shingle of all of them, or none."""
    return np.unique(window_hashes(words, size) if len(words) >= size else window_hashes(words, len(words)) if len(words) else words)
