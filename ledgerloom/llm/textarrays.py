"""Text columns as numpy arrays: Arrow string buffers, word bounds, 64-bit word and shingle hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes; A-Z fold to a-z. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


#: Bytes over which hashes of words are summed at once.
STRETCH = 1 << 19
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, from exponent 1 on, ``n`` at least; kept for the next call."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, STRETCH + 4096)
        _POWERS[:] = [(np.cumprod(np.full(size, _MULT, np.uint64)), np.cumprod(np.full(size, _INV, np.uint64)))]
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch ``data[start[i]:end[i]]`` (in order of start), worked out piece by piece in bounded memory."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + STRETCH)))
        base, stop = start[i], end[j - 1]
        power, inverse = powers(int(stop - base) + 1)
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:stop]] * power[: stop - base], out=total[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()).fill_null(b"") if raw else column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


def long_rows_cut(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, row of each stretch): rows of over ``most`` bytes in stretches that end at white space, so that no word is cut."""
    cuts, size = [offsets], np.diff(offsets)
    for r in np.flatnonzero(size > most):
        blank = np.flatnonzero(SPACE[data[offsets[r] : offsets[r + 1]]])
        want = np.arange(most, size[r], most)
        at = np.searchsorted(blank, want)
        cuts.append(offsets[r] + np.unique(blank[at[at < len(blank)]]))
    if len(cuts) == 1:
        return offsets, np.arange(len(size))
    inner = np.setdiff1d(np.concatenate(cuts[1:]), offsets)
    out = np.sort(np.concatenate([offsets, inner]), kind="stable")
    return out, _row_of(out, offsets)


def _row_of(cuts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each stretch; stretches of no bytes belong to the empty rows in turn."""
    starts = cuts[:-1]
    row = np.searchsorted(offsets, starts, "right") - 1
    empty = np.flatnonzero(np.diff(cuts) == 0)
    row[empty] = np.flatnonzero(np.diff(offsets) == 0)
    return row


class Words:
    """The words of rows [lo, hi): ``start``, ``end`` (byte places), ``row``, and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, fold: bool = True):
        base = offsets[lo]
        self.offsets = offsets[lo : hi + 1] - base
        raw = data[base : offsets[hi]]
        self.data = FOLD[raw] if fold else raw
        inside = ~SPACE[raw]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(raw):
            cuts = self.offsets[(self.offsets >= 0) & (self.offsets < len(raw))]
            before[cuts] = False
            before[0] = False
            after[-1] = False
            after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(hi - lo), np.diff(self.first))
        self._hash: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, whatever its place; worked out over stretches of bounded length."""
        if self._hash is None:
            self._hash = range_hashes(self.data, self.start, self.end)
        return self._hash

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of distinct shingles, sorted by row then hash; rows with fewer words give one."""
        words, counts = self.hashes(), np.diff(self.first)
        m = max(0, len(words) - width + 1)
        roll = np.full(m, 7, np.uint64)
        for k in range(width):
            roll = mix(roll * np.uint64(31) + words[k : k + m])
        inside = self.row[:m] == self.row[width - 1 : width - 1 + m] if m else np.zeros(0, bool)
        rows, hashes = [self.row[:m][inside]], [roll[inside]]
        for r in np.flatnonzero((counts > 0) & (counts < width)):
            h = np.full(1, counts[r] + 1000, np.uint64)
            for w in words[self.first[r] : self.first[r + 1]]:
                h = mix(h * np.uint64(31) + w)
            rows.append(np.array([r]))
            hashes.append(h)
        row, h = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        return row[keep], h[keep]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each piece, one piece after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.zeros(0, np.int64)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out[heads] = starts
    out[heads[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)
