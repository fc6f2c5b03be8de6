"""Vectorised text primitives that work on the UTF-8 buffers of Arrow columns.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters, compared after
lower-casing.  Lower-casing never turns a word character into another kind, so the n-th word of the
lower-cased text is the n-th word of the source text whatever happens to byte offsets.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[str, np.ndarray] = {"m": np.ones(1, dtype=U64), "i": np.ones(1, dtype=U64)}

#: Bytes of text handled at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes whose sums are made at a time, so that they stay in the processor's cache; one longer word is a piece of its own.
PIECE_BYTES = 1 << 15


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["m"].size < n:
        for key, base in (("m", _MULT), ("i", _INV)):
            steps = np.full(n, base, dtype=U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=U64)
    m, i = _powers["m"][:n], _powers["i"][:n]
    if n > 4 * SLICE_BYTES:  # don't keep the tables of one giant text
        _powers["m"], _powers["i"] = m[:SLICE_BYTES].copy(), i[:SLICE_BYTES].copy()
    return m, i


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(offs), dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Gives memory that the worker holds but doesn't use back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
        del batch
        release()


def boundaries(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, in order; no word crosses a row."""
    if not data.size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = _WORD[data]
    other = np.empty_like(inside)
    other[0], other[1:] = False, inside[:-1]
    first = offs[:-1]
    other[first[first < data.size]] = False
    starts = np.flatnonzero(inside & ~other)
    other[-1], other[:-1] = False, inside[1:]
    last = offs[1:]
    other[last[last > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~other) + 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all rows, and the offsets of the rows among them."""
    data, offs = buffers(pc.utf8_lower(column))
    starts, ends = boundaries(data, offs)
    if not starts.size:
        return np.zeros(0, dtype=U64), np.zeros(len(offs), dtype=np.int64)
    found, at = np.empty(starts.size, dtype=U64), 0
    while at < starts.size:
        # sums from the first byte of any word on give the same hashes
        first = int(starts[at])
        after = max(at + 1, int(np.searchsorted(ends, first + PIECE_BYTES, "right")))
        start, end = starts[at:after] - first, ends[at:after] - first
        power, inverse = _power(int(end[-1]))
        total = np.empty(power.size + 1, dtype=U64)
        total[0] = 0
        np.cumsum(_BYTE[data[first : first + power.size]] * power, dtype=U64, out=total[1:])
        found[at:after] = (total[end] - total[start]) * inverse[start]
        at = after
    return mix64(found + (ends - starts).astype(U64)), np.searchsorted(starts, offs)


def terms(column: pa.Array, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows and of their proper prefixes of so many bytes, and each one's row.

    A prefix and a word of the same bytes have different hashes, as have prefixes of different lengths.
    """
    data, offs = buffers(pc.utf8_lower(column))
    starts, ends = boundaries(data, offs)
    if not starts.size:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    power, inverse = _power(data.size)
    total = np.empty(data.size + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power, dtype=U64, out=total[1:])
    row = np.searchsorted(offs, starts, "right") - 1
    size = ends - starts
    found, rows = [mix64((total[ends] - total[starts]) * inverse[starts] + size.astype(U64))], [row]
    for n in lengths:
        at = starts[size > n]
        found.append(mix64((total[at + n] - total[at]) * inverse[at] + U64((n + 1) << 40)))
        rows.append(row[size > n])
    return np.concatenate(found), np.concatenate(rows)


class TermSet:
    """Membership of hashes in a fixed set: a bitmap first, then a sorted search; gives positions in ``hashes``."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(U64))
        bits = max(16, int(max(1, self.hashes.size * 32)).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << bits, dtype=bool)
        self.bitmap[(self.hashes & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes in the set, and where each is in it."""
        if not self.hashes.size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.bitmap[(hashes & self.mask).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[at])
        place[place == self.hashes.size] = 0
        ok = self.hashes[place] == hashes[at]
        return at[ok], place[ok]


def token_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the tokens of all rows, where a word or any other character but ASCII white space is one token, and the rows' offsets among them."""
    if not data.size:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offs), dtype=np.int64)
    mark = ~_WORD[data] & ~_SPACE[data]
    mark[boundaries(data, offs)[0]] = True
    starts = np.flatnonzero(mark)
    return starts, np.searchsorted(starts, offs)


def ngrams(hashes: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row and their row offsets; a row of 1 to n-1 words has one, of all its words."""
    count = np.diff(offs)
    end = np.repeat(offs[1:], count)
    here = np.arange(hashes.size, dtype=np.int64)
    out = np.zeros(hashes.size, dtype=U64)
    padded = np.concatenate([hashes, np.zeros(n, dtype=U64)])
    for k in range(n):
        part = padded[k : k + hashes.size] * U64((_MULT * (2 * k + 1) ** 3) & ((1 << 64) - 1) | 1)
        out += np.where(here + k < end, part, U64(0))
    keep = (here + n <= end) | (here == np.repeat(offs[:-1], count))
    total = np.concatenate([[0], np.cumsum(keep)])
    return mix64(out[keep]), total[offs]
