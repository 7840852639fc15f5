"""Views of Arrow text columns as NumPy arrays, and hashes over them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier and its inverse modulo 2**64, for hashes of byte runs by differences of prefix sums.
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_values() -> np.ndarray:
    """256 well-mixed 64-bit values, one for each byte."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and its offsets into them (rows + 1)."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, each with its view; whole rows only."""
    for batch in batches:
        _, offsets = view(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            part = batch.slice(row, end - row)
            yield part, *view(part.column(column))
            row = end
    give_back()


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and Spark may keep many."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # elsewhere the allocator does so by itself
        _LIBC.malloc_trim(0)


_POWERS: dict[str, np.ndarray] = {}
#: Powers that a worker keeps; those for longer data are made anew.
KEPT_POWERS = 1 << 20


def powers(n: int, step: np.uint64, name: str) -> np.ndarray:
    """step**0 .. step**(n-1) modulo 2**64; kept for later calls up to ``KEPT_POWERS``."""
    if name in _POWERS and len(_POWERS[name]) >= n:
        return _POWERS[name][:n]
    full = np.full(max(n, 1 << 16), step, np.uint64)
    full[0] = 1
    made = np.multiply.accumulate(full)
    if len(made) <= KEPT_POWERS:
        _POWERS[name] = made
    return made[:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] that depend on the content of the run alone."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data), STEP, "up"), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, STEP_INVERSE, "down")[starts])


_PLACES: list[np.ndarray] = [np.zeros(0, np.uint64)]


def places(n: int) -> np.ndarray:
    """A well-mixed odd 64-bit value for each place in a run; kept for later calls."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = mix(np.arange(max(n, 1 << 12), dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return _PLACES[0][:n]


def tabulated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the non-empty runs data[start:end], which don't overlap and are in order.

    Every byte passes a non-linear scramble with a value of its place, and these are summed. So there
    are no families of runs that collide whatever the values, as polynomials modulo 2**64 have them.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    x = values[data[at + np.repeat(starts, size)]] + places(int(size.max()))[at]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return mix(np.add.reduceat(x, first) + size.astype(np.uint64) * STEP)


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[start : start + size] equals other[other_start : other_start + size], run by run."""
    out = np.ones(len(sizes), bool)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        size = sizes[some]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = data[at + np.repeat(starts[some], size)] == other[at + np.repeat(other_starts[some], size)]
        out[some] = np.logical_and.reduceat(equal, first)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a row's end, and the first run of each row (rows + 1)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)
