"""Words of a batch of texts as NumPy arrays, read straight from Arrow's UTF-8 buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  No byte of a
multi-byte UTF-8 character lies in that set, so bytes split a text where code
points would.  A batch is handled as one byte array with a separator after each
text; nothing loops over characters or words in Python.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

# Bytes that separate words (fixed by the definition of a word).
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = 4096


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS = _powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair (a, b), elementwise."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b + np.uint64(0xA0761D6478BD642F))


def joined(column: pa.ChunkedArray | pa.Array, separator: int = 0x0A) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by ``separator``, and their n + 1 bounds.

    Null counts as the empty text.  Text i lies in ``[bounds[i], bounds[i + 1] - 1)``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0] + np.arange(n + 1)
    out = np.full(len(data) + n, separator, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = data
    return out, bounds


def spans(data: np.ndarray, outside: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array that ends in a separator (or is empty).

    ``outside`` marks the bytes that separate words.
    """
    out = outside[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], out)).astype(np.int8)))
    return edge[0::2], edge[1::2]


def _polynomials(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    longest = int(lengths.max())
    powers = _POWERS if longest <= _STEP else _powers(longest)
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()), dtype=np.int32 if longest < 1 << 30 else np.int64)
    within -= np.repeat(first.astype(within.dtype), lengths)
    with np.errstate(over="ignore"):
        terms = (data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers[within]
        sums = np.zeros(len(starts), dtype=np.uint64)
        full = lengths > 0
        if full.any():
            sums[full] = np.add.reduceat(terms, first[full])
    return sums


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """64-bit hash of each span: a polynomial of its bytes, mixed with its length.

    Spans are worked on about ``step`` bytes at a time, which bounds the scratch arrays.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    part = np.cumsum(lengths) // step
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(starts)]))
    sums = [
        _polynomials(data, starts[a:b], lengths[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]
    return combine(np.concatenate(sums), lengths.astype(np.uint64))


def slices(batch: pa.RecordBatch, column: int | pa.Array, limit: int = 1 << 20):
    """Consecutive parts of a batch whose texts hold about ``limit`` bytes (one row at least).

    The texts are a column of the batch, or an array as long as it.
    """
    lengths = np.zeros(batch.num_rows, dtype=np.int64)
    texts = (batch.column(column) if isinstance(column, int) else column).cast(pa.large_binary())
    if batch.num_rows:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lengths = np.diff(offsets)
    group = np.cumsum(lengths) // limit
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def released(batches):
    """The same batches; memory that one has freed is given back before the next.

    Python workers live on from stage to stage, so what an allocator keeps adds up.
    """
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)
