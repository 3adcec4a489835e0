"""Words and shingles of whole text columns as numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``. All functions work on the bytes of an
Arrow string array at once; memory follows ``WINDOW`` bytes and the number of
words, not the length of the longest text times eight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, WINDOW + 1), base, np.uint64)
        out[0] = 1
        _POWERS[kind] = have = np.multiply.accumulate(out)
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows); a null row is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(offsets: np.ndarray, limit: int = 2 * WINDOW) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of all words; rows are never joined."""
    full = ~BLANK[data]
    before = np.empty(len(full), bool)
    before[:1], before[1:] = False, full[:-1]
    after = np.empty(len(full), bool)
    after[-1:], after[:-1] = False, full[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans given in order and apart from each other."""
    out, at, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while at < n:
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + WINDOW, "right")))
        piece = data[low : int(ends[to - 1])].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _powers(_BASE, "up", len(piece))[: len(piece)], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        value = (sums[e] - sums[s]) * _powers(_INVERSE, "down", len(piece) + 1)[s]
        out[at:to] = mix(value + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def joined_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` words in a row, one for each start that has ``k`` words left."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(3) + words[j : j + n] + np.uint64(j + 1))
    return out


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, A-Z read as a-z."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    return span_hashes(low, starts, ends), rows


def shingle_sets(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row.

    A row with fewer than ``k`` words has its whole sequence as one shingle, a row
    without words an empty set.
    """
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    grams = joined_hashes(words, k)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(joined_hashes(words[a:b], b - a))
        else:
            sets.append(grams[:0])
    return sets
