"""Words and word hashes of many texts at once, on Arrow buffers with numpy.

A batch is cut into slices of whole texts of about `SLICE_BYTES`, so that the arrays stay
small whatever the batch holds; one longer text is a slice of its own. Hashes are sums of
per-byte random values times powers of an odd number, mod 2^64, and depend on the bytes
of the word alone.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def table(*spans: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes belong to words: all but those in the inclusive spans."""
    keep = np.ones(256, bool)
    for low, high in spans:
        keep[low : high + 1] = False
    return keep


BLANKS = ((0x20, 0x20), (0x09, 0x0D))
# Words as `[^\x20\x09-\x0D]+`; in UTF-8 no byte of another character is one of these.
NOT_BLANK = table(*BLANKS)
# Words as `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + U(1)) * _GOLD)


class _Powers:
    """Powers of an odd base and of its inverse mod 2^64, grown as needed."""

    def __init__(self, base: int):
        self._bases = (base, pow(base, -1, 1 << 64))
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def _grown(self, which: int, n: int) -> np.ndarray:
        t = self._tables[which]
        if len(t) < n:
            # a power-of-two length, doubled by one multiplication each time
            while len(t) < n:
                step = U(pow(self._bases[which], len(t), 1 << 64))
                t = np.concatenate([t, t * step])
            self._tables[which] = t
        return t

    def up(self, n: int) -> np.ndarray:
        return self._grown(0, n)[:n]

    def down(self, n: int) -> np.ndarray:
        return self._grown(1, n)[:n]


_BYTE_POWERS = _Powers(_BASE)
_GRAM_POWERS = (_Powers(0x9FB21C651E98DF25), _Powers(0xA24BAED4963EE407))


class Slice(NamedTuple):
    """Some whole texts: rows [row, row + len(offsets) - 1) of the batch."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield Slice(row, raw[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop


class Words(NamedTuple):
    """Byte spans of all words of a slice; text i has words [first[i], first[i + 1])."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(s: Slice, keep: np.ndarray = NOT_BLANK) -> Words:
    inside = keep[s.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(s.offsets) > 0)
    begins[s.offsets[filled]] = inside[s.offsets[filled]]
    last = s.offsets[filled + 1] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, s.offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _BYTE_POWERS.up(len(data)), out=sums[1:])
    h = (sums[end] - sums[start]) * _BYTE_POWERS.down(len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * _GOLD)


def gram_hashes(values: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each run of n values; the run may cross texts, see `inside_text`."""
    m = len(values)
    if m < n:
        return np.zeros(0, np.uint64)
    powers = _GRAM_POWERS[which]
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(values * powers.up(m), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers.down(m - n + 1))


def inside_text(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of n words from each word stays in its text; for words [0, m - n]."""
    m = int(first[-1])
    if m < n:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(m)
    return left[: m - n + 1] >= n


def sliding(x: np.ndarray, n: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over each n neighbours, by doubling."""
    if len(x) < n:
        return x[:0]
    width, y = 1, x
    while width * 2 <= n:
        y = take(y[:-width], y[width:])
        width *= 2
    return take(y[: len(x) - n + 1], y[n - width :][: len(x) - n + 1]) if width < n else y
