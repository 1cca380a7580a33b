"""Word-shingle sets of a batch of texts and their HyperMinHash registers, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from seasonloom.llm.bytetext import LOWER, combine, hashes, joined, mix, spans

MANTISSA_BITS = 10
EMPTY = np.uint16(0xFFFF)


def shingles(texts: pa.Array, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different word shingles, ascending, and their n + 1 bounds.

    Letters A-Z count as lower case.  A text with fewer words than ``width`` is one shingle
    of all its words; a text without words has none.
    """
    data, bounds = joined(texts)
    data = LOWER[data]
    starts, ends = spans(data)
    word = hashes(data, starts, ends)
    text_of = np.searchsorted(bounds, starts, side="right") - 1
    n = np.bincount(text_of, minlength=len(bounds) - 1)
    first = np.cumsum(n) - n
    rolled = word.copy()
    for k in range(1, min(width, len(word))):
        rolled[: len(word) - k] = combine(rolled[: len(word) - k], word[k:])
    at = np.arange(len(word)) - first[text_of]
    full = at + width <= n[text_of]
    owner, value = text_of[full], rolled[full]
    few = np.flatnonzero((n > 0) & (n < width))
    short = word[first[few]]
    for k in range(1, width):
        more = n[few] > k
        short[more] = combine(short[more], word[first[few][more] + k])
    # Short texts are told apart from shingles, and by their number of words.
    short = combine(short, n[few].astype(np.uint64))
    owner, value = np.concatenate((owner, few)), np.concatenate((value, short))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(bounds) - 1))))


@dataclass(frozen=True)
class Layout:
    """``bands`` bands of ``rows`` registers; a pair of similarity s meets in no band with
    probability (1 - s ** rows) ** bands."""

    bands: int = 40
    rows: int = 6

    @property
    def registers(self) -> int:
        return self.bands * self.rows


@lru_cache(maxsize=4)
def _probes(n: int) -> np.ndarray:
    """For each register a fixed order of all registers."""
    keys = mix(np.arange(n * n, dtype=np.uint64) + np.uint64(n)).reshape(n, n)
    return np.argsort(keys, axis=1, kind="stable").astype(np.int64)


def registers(values: np.ndarray, bounds: np.ndarray, layout: Layout) -> np.ndarray:
    """One row of registers per set; a row of ``EMPTY`` for an empty set.

    The hash range is cut into as many buckets as there are registers.  A register keeps the
    smallest hash of its bucket as its count of leading zeros and the mantissa bits that
    follow its leading one.  An empty bucket copies the first full one in a fixed random
    order of its own, so registers of two sets agree with probability equal to their
    similarity however small the sets are.
    """
    n, m = len(bounds) - 1, layout.registers
    out = np.full((n, m), EMPTY, dtype=np.uint16)
    if not len(values):
        return out
    owner = np.repeat(np.arange(n), np.diff(bounds))
    high = values >> np.uint64(32)
    spot = high * np.uint64(m)
    bucket = (spot >> np.uint64(32)).astype(np.int64)
    # Position inside the bucket: the rest of the product, then the low half of the hash.
    inside = ((spot & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | (values & np.uint64(0xFFFFFFFF))
    first = np.ones(len(values), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    inside = mix(inside)
    edge = np.flatnonzero(first)
    least = np.minimum.reduceat(inside, edge)
    exponent = np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    rest = least << (zeros + np.uint64(1))
    mantissa = rest >> np.uint64(64 - MANTISSA_BITS)
    packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa
    out[owner[edge], bucket[edge]] = packed.astype(np.uint16)
    probes = _probes(m)
    filled = out != EMPTY
    some = filled.any(axis=1)
    row, column = np.nonzero(~filled & some[:, None])
    for t in range(m):
        if not len(row):
            break
        source = probes[column, t]
        ok = filled[row, source]
        out[row[ok], column[ok]] = out[row[ok], source[ok]]
        row, column = row[~ok], column[~ok]
    return out


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of paired rows of registers, corrected for registers that agree by chance.

    Different elements agree when leading zeros and mantissa agree; over sets of the given
    sizes that has probability close to the sum over zeros z of 4 ** -(z + 1), which is one
    third, times 2 ** -mantissa bits, for hashes that follow the same minimum law.
    """
    same = (a == b).mean(axis=1)
    ratio = np.minimum(size_a, size_b) / np.maximum(np.maximum(size_a, size_b), 1)
    chance = ratio * (2.0**-MANTISSA_BITS) * (2.0 / 3.0)
    return np.maximum(0.0, (same - chance) / (1.0 - chance))
