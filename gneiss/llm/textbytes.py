"""Vectorised text kernels shared by the Python-side operators: UTF-8 buffers, words, rolling hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
#: Texts are hashed in pieces of about so many bytes, which bounds a worker's memory; one longer text makes a longer piece.
PIECE = 1_000_000

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for name, step in (("up", _BASE), ("down", inverse)):
            table = np.full(n, step, dtype=U)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**i modulo 2**64; span() takes hashes of ranges from them."""
    up, _ = _power(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=U)
    out[0] = 0
    np.cumsum(values * up[: len(values)], dtype=U, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each range of what prefix() has seen."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def rolling(sums: np.ndarray, width: int, mixed: bool = True) -> np.ndarray:
    """span() of every range of one width; if not mixed, before its finaliser."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, dtype=U)
    _, down = _power(len(sums))
    out = sums[width:] - sums[:n]
    out *= down[:n]
    return mix(out) if mixed else out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of so many values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `limit` bytes."""
    limit = limit or PIECE
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+`, and the number of words before each text (one entry more than texts)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_NOISE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit value for each byte, to sum in prefix()."""
    return _NOISE[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span(prefix(byte_values(data)), starts, ends)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges' contents end to end, and where each begins."""
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(at[-1]) + np.repeat(starts - at[:-1], size)
    return data[index], at


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in at least one of the ranges."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges in order, those that overlap or touch as one. It takes memory by the ranges, not by the places they cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])[: len(starts)]
    return starts[new], ends[np.append(new[1:], True)[: len(starts)]]
