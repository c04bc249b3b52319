"""Reversible stream transforms and content-defined cuts as NumPy kernels over bytes."""

from __future__ import annotations

import hashlib

import numpy as np

MODULUS = 1 << 32
#: Limits of cut lengths.
LEAST_CUT, SMALLEST_AVERAGE, LARGEST_AVERAGE, LARGEST_PIECE = 8192, 1 << 14, 1 << 20, 4 << 20

#: A 64-bit value for each byte, from a rule.
GEAR = np.array([int(hashlib.sha256(f"gear:{t}".encode()).hexdigest()[:16], 16) for t in range(256)], dtype=np.uint64)


def check_average(average: int) -> int:
    if average & (average - 1) or not SMALLEST_AVERAGE <= average <= LARGEST_AVERAGE:
        raise ValueError("average must be a power of two from 16 KiB to 1 MiB")
    return average


def samples(data: bytes, width: int) -> np.ndarray:
    """Signed little-endian integers of 2, 3 or 4 bytes."""
    if width not in (2, 3, 4) or len(data) % width:
        raise ValueError("whole samples of 2, 3 or 4 bytes are needed")
    wide = np.zeros((len(data) // width, 4), dtype=np.uint8)
    wide[:, 4 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return (wide.view("<i4").ravel() >> (8 * (4 - width))).astype(np.int64)


def canonical_pcm(data: bytes, width: int) -> tuple[bytes, dict[str, int]]:
    """Differences, less their common power of two and a common sign, modulo 2**32; and what restores the samples."""
    if len(data) > LARGEST_PIECE:
        raise ValueError("a piece has 4 MiB at most")
    x = samples(data, width)
    if not len(x):
        raise ValueError("no samples")
    d = np.diff(x)
    every = int(np.bitwise_or.reduce(np.abs(d))) if len(d) else 0
    shift = (every & -every).bit_length() - 1 if every else 0
    q = np.concatenate(([0], d >> shift))
    plus, minus = ((s * q % MODULUS).astype("<u4").tobytes() for s in (1, -1))
    sign = 1 if plus <= minus else -1
    return (plus if sign == 1 else minus), {"anchor": int(x[0]) % (1 << 8 * width), "shift": shift, "sign": sign, "frames": len(x)}


def restore_pcm(payload: bytes, meta: dict[str, int], width: int) -> bytes:
    """Samples of a canonical payload; the shape of both is checked first."""
    if set(meta) != {"anchor", "shift", "sign", "frames"} or any(type(v) is not int for v in meta.values()):
        raise ValueError("malformed parameters")
    if meta["sign"] not in (1, -1) or not 0 <= meta["shift"] < 32 or not 0 <= meta["anchor"] < 1 << 8 * width or not 1 <= meta["frames"] <= LARGEST_PIECE // width or len(payload) != 4 * meta["frames"]:
        raise ValueError("parameters out of range")
    p = np.frombuffer(payload, "<u4").astype(np.int64)
    if p[0]:
        raise ValueError("the first difference must be 0")
    mask = (1 << 8 * width) - 1
    steps = ((p << meta["shift"]) & mask) if meta["sign"] == 1 else (-(p << meta["shift"])) & mask
    x = (meta["anchor"] + np.cumsum(steps)) & mask
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def canonical_dsd(data: bytes) -> tuple[bytes, dict[str, int]]:
    """Each byte XOR the one before it, the first being 0, and the first byte."""
    if not data or len(data) > LARGEST_PIECE:
        raise ValueError("a piece has 1 byte to 4 MiB")
    x = np.frombuffer(data, np.uint8)
    return np.concatenate(([np.uint8(0)], x[1:] ^ x[:-1])).tobytes(), {"anchor": int(x[0])}


def restore_dsd(payload: bytes, meta: dict[str, int]) -> bytes:
    if set(meta) != {"anchor"} or type(meta["anchor"]) is not int or not 0 <= meta["anchor"] < 256 or not 0 < len(payload) <= LARGEST_PIECE or payload[0]:
        raise ValueError("malformed payload or parameters")
    p = np.frombuffer(payload, np.uint8)
    return (np.bitwise_xor.accumulate(p) ^ np.uint8(meta["anchor"])).tobytes()


def candidates(tokens: np.ndarray, average: int) -> np.ndarray:
    """Ends at which the gear hash's low bits are 0. These depend on the last log2(average) tokens alone, so all places are tested at once."""
    k = average.bit_length() - 1
    value = np.zeros(len(tokens), dtype=np.uint64)
    gear = GEAR[tokens]
    for j in range(min(k, len(tokens))):
        value[j:] += gear[: len(tokens) - j] << np.uint64(j)
    return np.flatnonzero((value & np.uint64(average - 1)) == 0) + 1


def content_cuts(data: bytes, kind: str, average: int) -> list[int]:
    """Ends of content-defined chunks: the first candidate at least max(8192, average / 4) bytes on, or 4 * average bytes on. kind: raw bytes, or dsd, whose tokens are each byte XOR the one before."""
    x = np.frombuffer(data, np.uint8)
    tokens = np.concatenate((x[:1], x[1:] ^ x[:-1])) if kind == "dsd" else x
    least, most = max(LEAST_CUT, average // 4), 4 * average
    found, at, ends = candidates(tokens, average), 0, []
    while at < len(x):
        i = np.searchsorted(found, at + least)
        end = int(found[i]) if i < len(found) and found[i] <= at + most else at + most
        at = min(end, len(x))
        ends.append(at)
    return ends


def frame_cuts(size: int, width: int, average: int) -> list[int]:
    """Ends of chunks of average / 4 samples, whatever their width; the last may be shorter."""
    if size % width:
        raise ValueError("a sample is cut short")
    step = average // 4 * width
    return [*range(step, size, step), size] if size else []
