"""Whole columns of text as flat numpy arrays: no Python object per word.

A slice of a column is one byte array with document offsets.  Words are runs of
bytes that a 256-entry table marks; UTF-8 bytes from 0x80 on stay together, so
byte tables express any class that only parts ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # of text that is worked on at once; a longer text is a slice of its own
_PIECE = 1 << 20  # of a slice whose words are hashed at once
_NEAR = 64  # bytes of a span whose random numbers lie in a table


def table(pattern_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = table(b for b in range(256) if b != 0x20 and not 9 <= b <= 13)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z are lower-cased)
ALNUM = table(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32, column.offset + len(column) + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLES: dict[int, np.ndarray] = {}


def _numbers(seed: int) -> np.ndarray:
    """A random number for each byte at each of the first places of a span."""
    if seed not in _TABLES:
        if len(_TABLES) >= 8:
            _TABLES.clear()
        _TABLES[seed] = mix(np.arange(_NEAR * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return _TABLES[seed]


class Words:
    """``start``, ``end`` (bytes) and ``hash`` of all words; ``first[d]:first[d+1]`` are those of document d."""

    __slots__ = ("end", "first", "hash", "start")

    def __init__(self, start, end, hash_, first):
        self.start, self.end, self.hash, self.first = start, end, hash_, first

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray, seed: int | None = 0) -> Words:
    """The words of each document, without hashes if ``seed`` is None.  Documents never share a word."""
    mark = inside[buf]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    start = mark.copy()
    start[1:] &= ~mark[:-1]
    start[cuts] = mark[cuts]
    end = mark.copy()
    end[:-1] &= ~mark[1:]
    end[cuts - 1] = mark[cuts - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(start, end, None if seed is None else span_hashes(buf, start, end, seed), np.searchsorted(start, off))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes (not empty, in order, apart): the sum of a random number for each byte and place.

    Two given spans get one hash with probability 2^-64 over the seeds; who
    needs certainty compares the bytes (``equal_spans``).
    """
    hashes = np.empty(len(start), np.uint64)
    near = _numbers(seed)
    lo = 0
    while lo < len(start):  # pieces end between spans
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _PIECE, side="right")))
        s, size = start[lo:hi], end[lo:hi] - start[lo:hi]
        first = np.cumsum(size) - size
        place = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
        code = place << 8 | buf[place + np.repeat(s, size)]
        if int(size.max()) <= _NEAR:
            value = near[code]
        else:
            far = place >= _NEAR
            value = near[np.where(far, 0, code)]
            value[far] = mix(code[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        hashes[lo:hi] = np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        lo = hi
    return mix(hashes)


def equal_spans(buf: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """Whether each span (not empty) of ``buf`` equals the bytes of ``other`` from the given start on."""
    out = np.empty(len(start), bool)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PIECE, side="right")))
        n = size[lo:hi]
        same = buf[ranges(start[lo:hi], n)] == other[ranges(other_start[lo:hi], n)]
        out[lo:hi] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        lo = hi
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (of the flat array: mask those that cross documents)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += h[i : i + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive entries."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = w - span
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]


def spaced(buf: np.ndarray, w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space between, and where each begins and ends there."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - size - 1
    text = np.full(int(start[-1] + size[-1]) if len(start) else 0, 0x20, np.uint8)
    text[ranges(start, size)] = buf[ranges(w.start, size)]
    return text.tobytes(), start, start + size


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(starts, lengths)])``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
