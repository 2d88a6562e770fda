"""Vectorised byte-level text primitives shared by the training-data operators.

Arrow hands a batch of texts over as one contiguous UTF-8 buffer plus offsets.
Everything here works on that buffer with numpy, so no Python code runs per
byte or per word.  Texts are cut into slices of bounded size (whole documents
only), which bounds the memory of a task whatever the batch size is.

Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII white space ends a word: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything that is not a-z, 0-9 or a byte of a non-ASCII character (after lower-casing).
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False
NOT_ALNUM[0x80:] = False

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 1, 2 * len(_pow))
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _P, _U)]), dtype=_U)
            _inv = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _P_INV, _U)]), dtype=_U)
    return _pow, _inv


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls become empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32, n + 1, array.offset * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(array: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents of at most
    ``budget`` bytes; a longer document is a slice of its own."""
    raw, off = column_bytes(array)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + budget, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word (n_docs + 1 long)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tail = offsets[1:][offsets[1:] > 0] - 1
    last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on the span's bytes alone."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of each document's first word)."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, separator)
    return span_hashes(low, starts, ends), first


def crc32_of_ids(ids) -> np.ndarray:
    """crc32 of each identifier written as text (a null identifier as empty text)."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) for i in ids), np.int64, len(ids))


def release() -> None:
    """Give freed memory back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """``run`` (a generator function over batches), followed by :func:`release`."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
