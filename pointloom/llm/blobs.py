"""Columns of numbers as one compressed binary value.

Rows of millions of small records are dealt to buckets as a few large values,
so Spark moves bytes, not rows; each column is compressed by itself.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard


@lru_cache(maxsize=1)
def _tools():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def dump(columns: list[np.ndarray], deltas: tuple[int, ...] = ()) -> bytes:
    """Columns of equal length; those named in ``deltas`` are stored as differences."""
    parts = [struct.pack("<II", len(columns), len(columns[0]))]
    for k, column in enumerate(columns):
        if k in deltas:
            column = np.diff(column, prepend=column[:1] * 0)
        raw = _tools()[0].compress(np.ascontiguousarray(column).tobytes())
        kind = column.dtype.str.encode()
        parts.append(struct.pack("<BBI", len(kind), k in deltas, len(raw)) + kind + raw)
    return b"".join(parts)


def load(blob: bytes) -> list[np.ndarray]:
    count, n = struct.unpack_from("<II", blob)
    at, out = 8, []
    for _ in range(count):
        size, delta, length = struct.unpack_from("<BBI", blob, at)
        kind = np.dtype(blob[at + 6 : at + 6 + size].decode())
        at += 6 + size
        column = np.frombuffer(_tools()[1].decompress(blob[at : at + length]), kind, n)
        out.append(np.cumsum(column, dtype=kind) if delta else column)
        at += length
    return out


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of several values, one after the other."""
    parts = [load(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 64-bit hash by its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(buckets: np.ndarray, columns: list[np.ndarray], deltas: tuple[int, ...] = ()):
    """(bucket, value) for each bucket that has rows; order within a bucket stays."""
    order = np.argsort(buckets, kind="stable")
    which = buckets[order]
    cuts = np.concatenate(([0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)])) if len(which) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        yield int(which[a]), dump([c[own] for c in columns], deltas)
