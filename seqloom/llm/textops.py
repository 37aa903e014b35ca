"""Vectorised words, lines and window hashes over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 that is the same
as the character pattern [^\\x20\\x09-\\x0D]+. Words and windows are compared by 64-bit hashes
(random byte values in a polynomial modulo 2**64, then a bijective mixer).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time, unless one text is longer.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
WINDOW_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `limit` bytes."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that do not cross rows."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first, last = offsets[:-1][offsets[1:] > offsets[:-1]], offsets[1:][offsets[1:] > offsets[:-1]] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Words:
    """The words of a run of rows: byte spans, and `rows`, the index of each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = _spans(_IS_WORD[data], offsets)
        self.rows = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; A-Z count as a-z if `lower`."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    values = (_LOWER_VALUES if lower else _BYTE_VALUES)[data]
    values *= _power_table(_BASE, len(data))
    np.cumsum(values, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * WINDOW_FACTORS[63])


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows' first lines of the \\n-split lines; every row has one at least."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    rows = before + np.arange(len(offsets))
    starts = np.empty(len(breaks) + len(offsets) - 1, np.int64)
    ends = np.empty_like(starts)
    place = np.arange(len(breaks)) + np.searchsorted(offsets[1:], breaks, "right")
    ends[place] = breaks
    starts[place + 1] = breaks + 1
    starts[rows[:-1]] = offsets[:-1]
    ends[rows[1:] - 1] = offsets[1:]
    return starts, ends, rows


def windows(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one row, and the index of each window's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = words[:n] * WINDOW_FACTORS[0]
    for j in range(1, k):
        h += words[j : j + n] * WINDOW_FACTORS[j]
    valid = np.ones(len(words), dtype=bool)
    for j in range(1, k):
        last = rows[1:] - j
        valid[last[last >= rows[:-1]]] = False
    at = np.flatnonzero(valid[:n])
    return mix(h[at]), at


def whole_hashes(words: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """One hash for the whole word sequence of each of the (short) rows `which`."""
    out = np.empty(len(which), np.uint64)
    for i, r in enumerate(which):
        w = words[rows[r] : rows[r + 1]]
        out[i] = (w * WINDOW_FACTORS[: len(w)]).sum(dtype=np.uint64)
    return mix(out + (rows[which + 1] - rows[which]).astype(np.uint64) * WINDOW_FACTORS[62])
