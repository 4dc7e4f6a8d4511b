"""Words of whole Arrow batches at once: places, hashes and n-grams as numpy arrays.

Texts are taken as UTF-8 bytes. All delimiters are ASCII, so no byte of a longer
character is mistaken for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows are handled in pieces of at most this many bytes of text (one row at least). A piece takes
#: some 50 times as much while it is handled, and a worker that is used again keeps part of that.
PIECE_BYTES = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_MULTIPLIER, size), _powers(_INVERSE, size)
        return self.up, self.down


_POWERS = _Powers()
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Ranges:
    """64-bit hashes of stretches of `values`, equal for equal contents."""

    def __init__(self, values: np.ndarray):
        up, self.down = _POWERS.get(len(values) + 1)
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each `values[start:end]`."""
    return Ranges(values).of(start, end)


@dataclass
class Piece:
    """Some rows of a batch: rows `first` to `last`, their bytes and their words.

    `bounds[d]:bounds[d + 1]` are the bytes of row `d` of the piece, `start:end` those of
    a word, `doc` its row, and `words[d]:words[d + 1]` the words of row `d`.
    """

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    words: np.ndarray

    def word_hashes(self) -> np.ndarray:
        return self.byte_ranges().of(self.start, self.end)

    def byte_ranges(self) -> Ranges:
        return Ranges(_BYTE_CODES[self.data])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the row bounds within them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw, bounds.astype(np.int64)


def spans(bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding at most `limit` bytes each, or one row."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def pieces(texts: pa.Array, lower: bool = False, delimiters: np.ndarray = SPACES, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The words of `texts`, piece by piece."""
    raw, every = text_bytes(texts)
    for first, last in spans(every, limit):
        bounds = every[first : last + 1] - every[first]
        data = raw[every[first] : every[last]]
        if lower:
            data = LOWER[data]
        inside = ~delimiters[data]
        filled = bounds[:-1][bounds[:-1] < bounds[1:]]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[filled] = inside[filled]
        closes[:-1] &= ~inside[1:]
        ends = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        closes[ends] = inside[ends]
        start, end = np.nonzero(opens)[0], np.nonzero(closes)[0] + 1
        doc = np.searchsorted(bounds, start, "right") - 1
        words = np.searchsorted(doc, np.arange(last - first + 1))
        yield Piece(first, last, data, bounds, start, end, doc, words)


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` values; run `i` starts at `i`."""
    at = np.arange(max(0, len(values) - n + 1))
    return range_hashes(values, at, at + n)
