"""Hashes of words and of runs of words, by whole-batch array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Places in a word for which a byte's number is looked up; it is worked out for later ones.
_PLACES = 64
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(byte: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A number of 64 bits for each byte and place in its word: as good as drawn, so that sums of different ones are not alike by their form."""
    at = place.astype(np.uint64) * np.uint64(256) + byte
    return mix(mix(at + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) ^ np.uint64(0xC2B2AE3D27D4EB4F))


def _table(seed: int) -> np.ndarray:
    if seed not in _tables:
        at = np.arange(256 * _PLACES)
        _tables[seed] = _numbers((at % 256).astype(np.uint64), at // 256, seed)
    return _tables[seed]


class Words:
    """The words of some texts: runs of bytes other than ASCII white space.

    data, start, end: bytes and each word's place in them; hash: of each word; first: each text's first word, and the end. A word's hash
    is the sum of numbers that stand for its bytes and their places, mixed; ``again`` makes a second one that has nothing to do with it.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data = data
        used = _LOWER[data] if lower else data
        n = len(data)
        gap = np.ones(n + 1, bool)
        gap[:n] = _SPACE[data]
        word = ~gap[:n]
        begins = word.copy()
        begins[1:] &= gap[: n - 1]
        stops = np.zeros(n + 1, bool)
        stops[1:n] = word[:-1] & gap[1:n]
        if n:
            stops[n] = word[-1]
        edges = bounds[(bounds > 0) & (bounds < n)]
        cut = edges[word[edges] & word[edges - 1]]  # a text ends in a word, and the next begins with one
        begins[cut] = True
        stops[cut] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops)
        self.used = used
        self.hash = self._hashes(1)
        self.first = np.searchsorted(self.start, bounds)

    def _hashes(self, seed: int) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        own = self.used[~_SPACE[self.data]]
        ends = np.cumsum(size)
        place = np.arange(len(own)) - np.repeat(ends - size, size)
        number = _table(seed)[np.minimum(place, _PLACES - 1) * 256 + own]
        if (far := np.flatnonzero(place >= _PLACES)).size:
            number[far] = _numbers(own[far].astype(np.uint64), place[far], seed)
        return mix(np.add.reduceat(number, ends - size) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def again(self) -> np.ndarray:
        """Second hashes of the words: with ``hash``, 128 bits."""
        return self._hashes(2)

    def runs(self, k: int, at: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
        """The hash of the ``k`` words from each word on, or from those at ``at``; the last k - 1 of all are missing in the first case.

        With ``of``, these words' hashes and other weights are used: a second hash of the same runs.
        """
        hashes, more = (self.hash, 0) if of is None else (of, 64)
        n = max(0, len(hashes) - k + 1)
        total = np.zeros(n if at is None else len(at), np.uint64)
        for j in range(k):
            w = hashes[j : j + n] if at is None else hashes[at + j]
            total += w * _weight(j + more)
        return mix(total + np.uint64(k))


def _weight(j: int) -> np.uint64:
    return np.uint64((0xA0761D6478BD642F * (2 * j + 1) ^ (0xE7037ED1A0B428DB * (j + 1))) & 0xFFFFFFFFFFFFFFFF | 1)


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of slices of a string column, of about ``most`` bytes each or one text; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"") if column.null_count else column
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each text's distinct hashes of ``k`` words in a row, sorted; of all its words if it has fewer; empty if it has none."""
    if not len(words.hash):
        return [np.zeros(0, np.uint64)] * (len(words.first) - 1)
    runs, found = words.runs(k), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            found.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            found.append(words.runs(b - a, np.array([a])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
