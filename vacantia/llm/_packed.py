"""Packed exchange of hashed keys and counts.

A task's distinct 64-bit keys are sorted, cut into ranges of the hash space (one
for each merging task) and sent as one compressed row a range, instead of one
row a key: sorted keys cost under six bytes each, small counts far less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

U64 = np.uint64


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the ``parts`` equal ranges of the hash space in sorted ``keys``."""
    edges = [(k << 64) // parts for k in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]]).astype(np.int64)


def _planes(x: np.ndarray, level: int = 1) -> bytes:
    """Bytes of equal significance side by side, then compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), level)


def _joined(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=U64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_joined(blob, np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64), 6)


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(blob)
    return _joined(blob, np.uint32 if len(raw) == 4 * n else np.uint64).astype(np.int64)


def cut(keys: np.ndarray, counts: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(range, packed keys, packed counts) of each range that has keys."""
    bounds = ranges(keys, parts)
    for k in np.flatnonzero(np.diff(bounds)):
        at = slice(bounds[k], bounds[k + 1])
        yield int(k), pack_keys(keys[at]), [pack_counts(c[at]) for c in counts]
