"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8
continuation bytes are never in that class, so bytes and code points agree.
All functions work on whole texts; temporaries are bounded by walking the
words in spans of at most ``SPAN`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPAN = 1 << 20
_U64 = np.uint64

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift, multiply)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


#: A 64-bit value for each byte, and the base of the positional powers.
BYTE_VALUE = _mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
BASE = _U64(0xD6E8FEB86659FD93)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = int(bounds[0]) if len(bounds) else 0
    return raw[start : int(bounds[-1]) if len(bounds) else 0], bounds - start


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words; text i has words first[i]:first[i+1]."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    ink = ~WHITE[raw]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    cuts = bounds[1:][bounds[1:] > 0] - 1
    after[cuts] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash per word: positional polynomial over byte values, mixed with the length."""
    out = np.empty(len(starts), _U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN, side="right")))
            s, e = starts[at:to], ends[at:to]
            lengths = e - s
            total = int(lengths.sum())
            local = np.cumsum(lengths) - lengths
            place = np.arange(total) - np.repeat(local, lengths)
            data = raw[place + np.repeat(s, lengths)]
            if lower:
                data = LOWER[data]
            powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, BASE, _U64))
            out[at:to] = np.add.reduceat(BYTE_VALUE[data] * powers[place], local)
            out[at:to] += lengths.astype(_U64) * _U64(0xA0761D6478BD642F)
            at = to
        return _mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes (order matters)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U64)
    with np.errstate(over="ignore"):
        acc = words[:n].copy()
        for k in range(1, size):
            acc = acc * BASE + words[k : k + n]
        return _mix(acc)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a whole (short) word sequence, apart from window hashes of any size."""
    with np.errstate(over="ignore"):
        acc = _U64(len(words)) * _U64(0xE7037ED1A0B428DB)
        for w in words:
            acc = acc * BASE + w
        return _mix(np.array([acc], _U64))


def slices(bounds: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each (one row at least)."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = to
