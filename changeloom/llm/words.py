"""Vectorised word and n-gram hashing over Arrow string columns.

A batch of texts is handled as one byte buffer: word borders, 64-bit word hashes and
n-gram hashes come from whole-buffer numpy operations, so the cost is some tens of
nanoseconds a byte and no Python object is made per word.  Chunks are cut between
documents at about a quarter of a megabyte, which bounds the scratch memory of a worker; a longer
document is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # 5 modulo 8: its powers repeat as late as possible
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words cut at white space, and of words of letters and digits only.
GRAPHIC = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        x ^= x >> np.uint64(shift) ^ x >> np.uint64(2 * shift)
        x *= np.uint64(pow(factor, -1, 1 << 64))
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for n positions at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES * 2)
        for k, x in enumerate((_BASE, _INVERSE)):
            factors = np.full(n + 1, x, np.uint64)
            factors[0] = 1
            _powers[k : k + 1] = [np.cumprod(factors)]
    return _powers


class Words(NamedTuple):
    """Words of a chunk of documents; document k has words first[k] to first[k + 1]."""

    row: int  # the chunk's first document in the batch
    data: np.ndarray  # bytes
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of documents of about limit bytes."""
    data, offsets = buffers(texts)
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1)
        stop = min(stop, n)
        yield k, data[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k]
        k = stop


def words(texts: pa.Array, kind: np.ndarray = GRAPHIC, fold: np.ndarray = SAME, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words (runs of bytes of the kind, within a document) of each chunk, hashed after folding bytes."""
    for row, data, offsets in chunks(texts, limit):
        inside = kind[data]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        before = np.concatenate([[False], inside])
        start = np.flatnonzero(inside & (~before[:-1] | border[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        end = np.flatnonzero(inside & (~after | border[1:])) + 1
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[fold[data]] * power[: len(data)], out=total[1:])
        sums = (total[end] - total[start]) * inverse[start]
        yield Words(row, data, start, end, mix(sums + (end - start).astype(np.uint64) * np.uint64(_STEP)), np.searchsorted(start, offsets))


def word_hash(word: bytes, fold: np.ndarray = SAME) -> int:
    """The hash that words() gives to a word."""
    return int(next(words(pa.array([word.decode()]), np.ones(256, bool), fold)).hash[0])


def ngrams(hashes: np.ndarray, n: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and which of them lie within one document."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= np.uint64(_STEP)
        out += hashes[k : k + size]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(out), doc[:size] == doc[n - 1 :]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths)
    return np.repeat(base, lengths) + np.arange(total)
