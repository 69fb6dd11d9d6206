"""Vectorised text kernels over Arrow string columns, shared by the operators.

A batch is two arrays: the UTF-8 bytes of its texts one after the other, and the byte offsets
of the texts. Words and units are arrays of start and end positions. No function loops over
words in Python, except over words longer than ``LONG`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Longest word hashed by eight-byte loads.
LONG = 64
#: Bytes of text that a kernel handles at once; one longer text is a batch by itself.
BATCH_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?;:#$%&*"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes together."""
    _, offs = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word (n + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    gap = sep[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    cut = offs[(offs > 0) & (offs < len(data))]
    before[cut] = True
    after[cut - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range."""
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
    if not len(size):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    mask = np.array([0] + [(1 << 8 * i) - 1 for i in range(1, 9)], np.uint64)
    most = min(int(size.max()), LONG)
    active = None
    for k in range(0, most, 8):
        if k:
            active = np.flatnonzero((size > k) & (size <= LONG)) if active is None else active[size[active] > k]
            s, n = starts[active], size[active]
            h[active] = mix(h[active] * _M2 ^ (loads[s + k] & mask[np.minimum(n - k, 8)]))
        else:
            h = mix(h * _M2 ^ (loads[starts] & mask[np.minimum(size, 8)]))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts where a tokenizer's own splitting always cuts.

    That is before white space that follows something else, and between an ASCII letter and a
    punctuation mark. Behind a character that may be non-ASCII white space no cut is made.
    Returns start, end, and each text's first unit (n + 1).
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    gap = SPACE[data]
    cut = gap.copy()
    cut[0] = False
    cut[1:] &= ~gap[:-1]
    cut[2:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
    lead = (data >= 0xE1) & (data <= 0xE3)
    cut[3:] &= ~lead[:-3]
    cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    first = offs[:-1][np.diff(offs) > 0]
    cut[first] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offs)


def shingles(word_hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words; a shorter text that has words is one run.

    Returns the hashes and each text's first shingle (n + 1).
    """
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    n = len(word_hashes)
    acc = np.zeros(n, np.uint64)
    mult = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1) for i in range(width))]
    for i in range(width):
        if n > i:
            acc[: n - i] += word_hashes[i:] * mult[i]
    at = np.repeat(first[:-1] - out_first[:-1], runs) + np.arange(out_first[-1])
    out = mix(acc[at] + np.uint64(width)) if n else np.zeros(0, np.uint64)
    for d in np.flatnonzero((count > 0) & (count < width)):
        h = word_hashes[first[d] : first[d + 1]]
        out[out_first[d]] = mix((h * np.array(mult[: len(h)], np.uint64)).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(0xABCD0000 + len(h)))[0]
    return out, out_first


def sort_within(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A copy in which each text's values are sorted."""
    out = values.copy()
    at = first.tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    return out


class Memo:
    """Values of 64-bit keys, kept between the batches of a task and bounded in number."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def full(self, more: int) -> bool:
        return len(self.keys) + more > self.limit

    def clear(self) -> None:
        self.keys, self.values = self.keys[:0], self.values[:0]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be sorted and new."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default=0) -> np.ndarray:
    """Values of sorted keys, ``default`` for the rest."""
    if not len(keys):
        return np.full(len(wanted), default, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)
