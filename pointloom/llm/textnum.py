"""Vectorised text kernels over Arrow string columns (numpy, no per-row Python).

Texts are handled as the concatenated UTF-8 bytes of many rows.  Substring
hashes come from one running sum: ``(C[e] - C[s]) * B**-s`` modulo 2**64, put
through a finaliser, so the hash of any span costs a few array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Spans of more bytes have a cryptographic hash.
LONG = 256
#: Bytes worked on at once where each takes many bytes of memory.
STEP = 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240501)
#: A random 64-bit value for each byte.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``most`` bytes of text and at most ``rows`` rows, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = lengths(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def _whole(column: pa.Array) -> pa.Array:
    column = column.fill_null("") if column.type in (pa.string(), pa.large_string()) else column.fill_null(b"")
    return column.cast(pa.large_binary())


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null counts as empty."""
    return np.diff(packed(column)[1])


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = _whole(column)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


class Sums:
    """Running sums of a byte buffer, for hashes of its spans."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.data = data
        self.sums = np.zeros(len(data) + 1, U)
        for at in range(0, len(data), STEP):
            own = self.sums[at + 1 : at + STEP + 1]
            np.cumsum(BYTE_CODE[data[at : at + STEP]] * up[at : at + len(own)], out=own)
            own += self.sums[at]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``[start, end)``; equal bytes, equal hash, wherever they are.

        Sums modulo a power of two collide on certain regular strings of a
        thousand bytes, whatever the base, so longer spans are hashed by BLAKE2.
        """
        out = mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))
        for k in np.flatnonzero(end - start > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.data[start[k] : end[k]], digest_size=8).digest())
        return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each row (one entry more).

    ``inside[b]`` tells if byte ``b`` belongs to words; words end with their row.
    """
    n = len(data)
    mask = np.zeros(n + 1, bool)
    mask[:n] = inside[data]
    first = mask[:n].copy()
    first[1:] &= ~mask[: n - 1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    first[cuts] = mask[cuts]
    start = np.flatnonzero(first)
    last = mask[:n] & ~mask[1:]
    ends = cuts[1:] - 1
    last[ends] = mask[ends]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the first word of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, with its length last."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start, start+1, ...`` of each range, one after the other."""
    size = size.astype(np.int64)
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)
