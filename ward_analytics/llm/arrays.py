"""Texts of an Arrow batch as flat numpy arrays: bytes, words, 64-bit names of words.

A batch is worked on in slices of a few MB, so the arrays of a task stay small however many rows a
batch has; a single text longer than that makes a slice of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc



def _give_memory_back() -> None:
    """Arrays of a few MB and more go back to the system when they are freed, where the C library can be told so; else a worker that is used again
    keeps the most it ever took."""
    mmap_threshold, trim_threshold = -3, -1  # fixed values of mallopt
    try:
        set_option = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    set_option(mmap_threshold, 4 << 20)
    set_option(trim_threshold, 16 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


_give_memory_back()

SLICE_BYTES = 4 << 20
#: Words longer than this are named by their digest instead of the polynomial: modulo a power of two, words of some thousand bytes
#: can be made that have equal polynomials for every base.
LONG_WORD = 64

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RANDOM = np.random.RandomState(20240131)
_BYTE_VALUE = _RANDOM.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(LONG_WORD + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and their offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes unchanged."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = False
    after[filled[1:] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each byte string [start, end); equal strings have equal names. The strings don't overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    long = np.flatnonzero(size > LONG_WORD)
    kept = np.minimum(size, LONG_WORD)
    first = np.concatenate(([0], np.cumsum(kept)[:-1]))
    total = int(kept.sum())
    local = np.arange(total, dtype=np.int32 if total < 2**31 else np.int64)
    local -= np.repeat(first.astype(local.dtype), kept)
    place = local + np.repeat(starts.astype(np.int32 if len(data) < 2**31 else np.int64), kept)
    value = np.add.reduceat(_BYTE_VALUE[data[place]] * _POWERS[local], first)
    for i in long:
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        value[i] = np.frombuffer(digest, np.uint64)[0]
    return mix(value ^ mix(size.astype(np.uint64)))


def windows(values: np.ndarray, width: int, salt: int = 1) -> np.ndarray:
    """A name for each run of ``width`` values, one for each start; empty if there are fewer values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = powers(width, (_BASE + 2 * salt * 0x2545F4914F6CDD1D) & (2**64 - 1))
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += mix(values[i : i + n]) * factor[i] if width < 4 else values[i : i + n] * factor[i]
    return mix(out)


def inside_one(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each start of a run of ``width`` among n values: whether the run stays in one text. first: as from ``spans``."""
    if n < width:
        return np.empty(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left[: n - width + 1] >= width


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integers of a column without nulls."""
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).to_numpy())
