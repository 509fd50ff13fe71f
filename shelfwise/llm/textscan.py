"""Vectorised reading of texts inside Arrow tasks.

Texts are scanned as UTF-8 bytes, many documents at a time: words are found by a
byte mask and hashed by one weighted sum per word, without a Python object per
word. Everything works on chunks of about ``CHUNK_BYTES``, so memory is bounded by
that or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words between the six ASCII white-space characters.
SPACED = ~np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
#: Words of ASCII digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def mix_int(x: int) -> int:
    """The finaliser of splitmix64 on a Python integer."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """The same on an array of uint64; returns a new array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_OF_BYTE = np.array([mix_int(b) | 1 for b in range(256)], dtype=np.uint64)
_POWERS = np.empty(0, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _POWERS = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
    return _POWERS


class Chunk(NamedTuple):
    """Rows ``first`` to ``first + len(offsets) - 1`` of a batch, as one byte array."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a chunk: where each starts and ends, its hash, and each row's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a batch in runs of whole rows of about ``size`` bytes; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        begin, end = int(offsets[first]), int(offsets[last])
        yield Chunk(first, data[begin:end], offsets[first : last + 1] - begin)
        first = last


def words(chunk: Chunk, is_word: np.ndarray = SPACED, lower: bool = True) -> Words:
    """The words of a chunk with 64-bit hashes; ASCII letters are lower-cased first.

    Two different words of one corpus get the same hash with a probability of about
    2**-64 a pair; nothing here compares the strings again.
    """
    data = LOWER[chunk.data] if lower else chunk.data
    flags = is_word[data]
    edge = np.zeros(len(flags) + 1, dtype=bool)
    edge[chunk.offsets] = True
    before = np.empty(len(flags) + 1, dtype=bool)
    before[0] = False
    before[1:] = flags
    begins = before[:-1] & ~edge[:-1]
    starts = np.flatnonzero(flags & ~begins)
    after = np.empty_like(flags)
    after[:-1] = flags[1:] & ~edge[1:-1]
    after[-1:] = False
    ends = np.flatnonzero(flags & ~after) + 1
    rows = np.searchsorted(starts, chunk.offsets)
    if not len(starts):
        return Words(starts, ends, np.empty(0, np.uint64), rows)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _OF_BYTE[data[flags]]
    values *= _powers(int(lengths.max()))[place]
    return Words(starts, ends, mix(np.add.reduceat(values, first)), rows)


def prefix_hashes(chunk: Chunk, found: Words, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of each word, apart from those of whole words."""
    data = LOWER[chunk.data]
    total = np.zeros(len(found.starts), dtype=np.uint64)
    powers = _powers(size)
    for k in range(size):
        at = found.starts + k
        inside = at < found.ends
        total[inside] += _OF_BYTE[data[at[inside]]] * powers[k]
    return mix(total ^ np.uint64(mix_int(size)))


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array: consecutive runs of ``values`` of the given lengths."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
