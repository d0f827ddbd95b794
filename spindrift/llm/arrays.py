"""Numpy helpers that the operators share: rolling hashes, byte planes, runs of sorted columns, groups of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
RADIX = 0x9E3779B97F4A7C15
#: A random odd number for each byte value.
BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX^i and its inverse modulo 2^64, for i up to n at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n, r, U)])) for r in (RADIX, pow(RADIX, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def planes(x: np.ndarray, width: int) -> bytes:
    """The numbers' low bytes, byte by byte, so that those that repeat compress."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data, width: int, kind=U) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(kind).ravel()


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spread(begin: np.ndarray, size: int) -> np.ndarray:
    """The run that each of `size` rows is in."""
    out = np.zeros(size, np.int64)
    out[begin] = 1
    return np.cumsum(out) - 1


def grouped(sizes, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes each, or of one longer row."""
    cuts, held = [0], 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            cuts.append(i)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True)) if len(sizes) else []


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text or binary value, without taking them out of the batch; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def text_groups(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row, texts as UTF-8) of a column, some `most` bytes at a time; null is empty."""
    for a, b in grouped(byte_sizes(column).tolist(), most):
        yield a, b, [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]


def buffers(column: pa.Array) -> Iterator[memoryview]:
    """The values of a binary column one by one, without a copy."""
    for value in column:
        yield memoryview(value.as_buffer())
