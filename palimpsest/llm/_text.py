"""Byte-level text helpers shared by the operators of this subpackage.

Everything here works on one bounded slice of an Arrow batch inside a task: words are found and hashed for the
whole slice with numpy, so no operator loops over words in Python.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z. Hashes are 64-bit
polynomial hashes over a seeded byte table, finished with a mixing step.
"""

from __future__ import annotations

import ctypes
import platform
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TABLE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}
_LIBC = ctypes.CDLL("libc.so.6") if platform.libc_ver()[0] == "glibc" else None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row starts (nulls are empty)."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about `limit` bytes of text each; a longer row comes alone."""
    _, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    release_memory()


def release_memory() -> None:
    """Give freed memory back: a worker stays for the stages after its own, beside the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def byte_prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] the hash of data[s:e] scaled by base**s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data), _BASE), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same wherever the bytes stand."""
    inverse = powers(len(prefix), _INV)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of a slice: byte ranges, hashes, and for each row where its words start."""

    def __init__(self, column: pa.Array):
        raw, self.rows = column_bytes(column)
        self.data = data = _LOWER[raw]
        n = len(data)
        inside = _IS_WORD[data]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edge = self.rows[1:-1]
            before[edge[edge < n]] = False
            after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.rows)
        self.prefix = byte_prefix_hash(data)
        self.hash = range_hash(self.prefix, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word shingle; a row with fewer words than `width` (but some) gives its whole sequence."""
    counts = words.counts
    h, row = words.hash, words.row
    if not len(h):
        return row, h
    place = np.arange(len(h)) - words.first[row]
    size = np.minimum(counts[row], width)
    keep = place <= np.maximum(counts[row] - width, 0)
    at, size, row = np.flatnonzero(keep), size[keep], row[keep]
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        use = size > j
        out[use] = out[use] * _U(_BASE) + h[at[use] + j]
    return row, mix(out + size.astype(np.uint64))


def distinct_by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, value) pairs."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if not len(row):
        return row, value
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]
