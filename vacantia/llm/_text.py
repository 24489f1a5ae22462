"""Vectorised tokenising of Arrow text columns.

Words are found and hashed on the UTF-8 bytes of many documents at once, so a
Python worker touches each byte a handful of times in numpy and never builds a
Python string for a word.  Every word class of the operators is a set of bytes
(all bytes from 0x80 on belong to letters), so bytes give the same words as
code points would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once by the numpy kernels of one Python worker.
SLICE_BYTES = 1 << 21


def byte_class(inside) -> np.ndarray:
    """A boolean table over the 256 byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words between ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of digits, letters and everything beyond ASCII (after lower-casing).
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # words compare with A-Z lower-cased
_POWERS = np.empty(64, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base, modulo 2**64."""
    global _POWERS
    if n > len(_POWERS) or _POWERS[0] != 1:
        size = max(64, 1 << (n - 1).bit_length())
        _POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _STEP, dtype=np.uint64)]), dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs get unrelated outputs."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Words:
    """Words of some documents: byte spans, 64-bit hashes, and where each document's words begin."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, starts, ends, hashes, first):
        self.starts, self.ends, self.hashes, self.first = starts, ends, hashes, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of the documents data[offsets[i]:offsets[i+1]]; ``first`` has one entry more than there are documents."""
    n = len(data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(none, none, np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    here = inside[data]
    begins = here.copy()
    begins[1:] &= ~here[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = here[edges]
    stops = here.copy()
    stops[:-1] &= ~here[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = here[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if len(starts) == 0:
        return Words(starts, ends, np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    lengths = ends - starts
    inner = np.flatnonzero(here)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(len(inner)) - np.repeat(heads, lengths)
    value = _BYTE[data[inner]] * _powers(int(lengths.max()))[at]
    hashes = mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64))
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, off, body = column.buffers()
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes (a longer document alone): first row, end row, bytes, offsets."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
