"""Container layouts: which bytes of a WAV, RF64, DSF or DFF file belong to which channel. Anything else is opaque.

Files are read through a Reader, so that only headers are touched by probing and only bounded ranges by channels.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

KEYS = ("container", "kind", "channels", "rate", "frames", "width", "valid_bits", "data_offset", "data_size", "block_size", "bit_order")
LAYOUT = "struct<container:string,kind:string,channels:long,rate:long,frames:long,width:long,valid_bits:long,data_offset:long,data_size:long,block_size:long,bit_order:string>"
#: Fixed values of the formats.
BLOCK, MOST_CHUNKS, MOST_FORMAT, MOST_PROPERTY = 4096, 100_000, 65_553, 1024
UNSIZED = 0xFFFFFFFF
PCM_GUID = bytes.fromhex("0100000000001000800000aa00389b71")
REVERSED = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], dtype=np.uint8)
DSF_CHANNELS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 5, 7: 6}
#: Bytes of a channel that are read at a time, and the most.
READ, MOST_READ = 256 << 10, 16 << 20


class _Bad(ValueError):
    """Not a layout that is understood."""


def _need(condition: bool) -> None:
    if not condition:
        raise _Bad


class Reader:
    """Exact positional reads of a file's bytes, or of bytes at hand."""

    def __init__(self, source: bytes | str | Path):
        self.data = source if isinstance(source, bytes) else None
        self.file = None if self.data is not None else Path(source).open("rb")
        self.size = len(self.data) if self.data is not None else Path(source).stat().st_size

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        if self.file:
            self.file.close()

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a place on; _Bad if the file ends before."""
        if self.data is not None:
            out = self.data[at : at + n] if at >= 0 else b""
        else:
            self.file.seek(at)
            out = self.file.read(n)
        _need(len(out) == n)
        return out

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self.read(at, struct.calcsize(form)))


def _padded(r: Reader, at: int, end: int, form: str, size_of: Callable[[bytes, int], int] = lambda _, n: n) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks of a range, each of odd size followed by a pad byte within the range."""
    head, n = struct.calcsize(form), 0
    while at != end:
        _need(at + head <= end and n < MOST_CHUNKS)
        name, size = r.unpack(form, at)
        size = size_of(name, size)
        yield name, at + head, size
        at, n = at + head + size + size % 2, n + 1
        _need(at <= end)


def _wave(r: Reader) -> dict:
    magic, total, form = r.unpack("<4sI4s", 0)
    large, main, samples, at = magic == b"RF64", None, 0, 12
    _need(form == b"WAVE" and large == (total == UNSIZED))
    sizes: dict[bytes, list[int]] = {}
    if large:
        name, length = r.unpack("<4sI", 12)
        _need(name == b"ds64" and length >= 28)
        total, main, samples, entries = r.unpack("<QQQI", 20)
        _need(entries <= MOST_CHUNKS and length == 28 + 12 * entries)
        for i in range(entries):
            name, n = r.unpack("<4sQ", 48 + 12 * i)
            _need(name != b"data")
            sizes.setdefault(name, []).append(n)
        at = 20 + length + length % 2
    end = total + 8
    _need(at <= end <= r.size)
    found: dict[bytes, tuple[int, int]] = {}

    def size_of(name: bytes, n: int) -> int:
        _need(name != b"ds64")
        if n != UNSIZED:
            return n
        if name == b"data" and large and b"data" not in found:
            return main
        _need(bool(sizes.get(name)))
        return sizes[name].pop(0)

    for name, start, n in _padded(r, at, end, "<4sI", size_of):
        if name in (b"fmt ", b"data"):
            _need(name not in found and n > 0)
            found[name] = start, n
    # Bytes behind the declared extent belong to no channel, like any other chunk's.
    _need(len(found) == 2 and not any(sizes.values()))
    (start, n), (offset, size) = found[b"fmt "], found[b"data"]
    _need(n <= MOST_FORMAT and main in (None, size))
    channels, rate, width, valid = _wave_format(r.read(start, n))
    _need(size % (channels * width) == 0)
    frames = size // (channels * width)
    _need(samples in (0, frames))
    return dict(zip(KEYS, ("rf64" if large else "wav", "pcm", channels, rate, frames, width, valid, offset, size, 0, "msb"), strict=True))


def _wave_format(payload: bytes) -> tuple[int, int, int, int]:
    """Channels, rate, bytes a sample and valid bits of integer PCM. What follows the first 16 bytes states its own length."""
    _need(len(payload) >= 16)
    tag, channels, rate, speed, align, bits = struct.unpack_from("<HHIIHH", payload)
    valid, rest = bits, len(payload) - 18
    _need(tag in (1, 0xFFFE) and (rest == -2 and tag == 1 or rest >= 0 and struct.unpack_from("<H", payload, 16)[0] == rest))
    if tag == 0xFFFE:
        _need(rest >= 22)
        valid, mask = struct.unpack_from("<HI", payload, 18)
        _need(payload[24:40] == PCM_GUID and mask.bit_count() in (0, channels))
    _need(1 <= channels <= 8 and rate > 0 and bits in (16, 24, 32) and 0 < valid <= bits)
    _need(align == channels * bits // 8 and speed == rate * align)
    return channels, rate, bits // 8, valid


def _dsf(r: Reader) -> dict:
    _, size, total, meta = r.unpack("<4sQQQ", 0)
    _need(size == 28 and total == r.size and (meta == 0 or 28 <= meta < r.size))
    at, end, n = 28, meta or r.size, 0
    shape: tuple | None = None
    body: tuple[int, int] | None = None
    while at != end:
        _need(at + 12 <= end and n < MOST_CHUNKS)
        name, size = r.unpack("<4sQ", at)
        _need(size >= 12 and at + size <= end and name != b"DSD ")
        if name == b"fmt ":
            _need(shape is None and body is None and size == 52)
            version, ident, kind, channels, rate, bits, count, block, spare = shape = r.unpack("<IIIIIIQII", at + 12)
            _need((version, ident, block, spare) == (1, 0, BLOCK, 0) and DSF_CHANNELS.get(kind) == channels and bits in (1, 8))
        elif name == b"data":
            _need(shape is not None and body is None)
            body = at + 12, size - 12
        at, n = at + size, n + 1
    _need(shape is not None and body is not None)
    _, _, _, channels, rate, bits, count, _, _ = shape
    return dict(zip(KEYS, ("dsf", "dsd", channels, rate, count, 1, 1, *body, BLOCK, "lsb" if bits == 1 else "msb"), strict=True))


def _dff(r: Reader) -> dict:
    _, size, form = r.unpack(">4sQ4s", 0)
    end = size + 12
    _need(form == b"DSD " and 16 <= end <= r.size)
    found: dict[bytes, tuple[int, int]] = {}
    for name, start, n in _padded(r, 16, end, ">4sQ"):
        _need(bool(found) or name == b"FVER")
        _need(name != b"DST " and (name not in (b"PROP", b"DSD ", b"FVER") or name not in found) and (name != b"DSD " or b"PROP" in found))
        found.setdefault(name, (start, n))
    _need({b"FVER", b"PROP", b"DSD "} <= found.keys() and found[b"FVER"][1] == 4 and r.read(found[b"FVER"][0], 1) == b"\1")
    at, size = found[b"PROP"]
    _need(size >= 4 and r.read(at, 4) == b"SND ")
    own: dict[bytes, bytes] = {}
    for name, start, n in _padded(r, at + 4, at + size, ">4sQ"):
        if name in (b"FS  ", b"CHNL", b"CMPR"):
            _need(name not in own and n <= MOST_PROPERTY)
            own[name] = r.read(start, n)
    _need(len(own) == 3 and len(own[b"FS  "]) == 4 and len(own[b"CHNL"]) >= 2)
    rate, channels, packing = int.from_bytes(own[b"FS  "], "big"), int.from_bytes(own[b"CHNL"][:2], "big"), own[b"CMPR"]
    _need(1 <= channels <= 8 and len(own[b"CHNL"]) == 2 + 4 * channels)
    _need(packing[:4] == b"DSD " and len(packing) >= 5 and len(packing) == 5 + packing[4])
    offset, body = found[b"DSD "]
    _need(body > 0 and body % channels == 0)
    return dict(zip(KEYS, ("dff", "dsd", channels, rate, body // channels * 8, 1, 1, offset, body, 0, "msb"), strict=True))


PROBES: dict[bytes, Callable[[Reader], dict]] = {b"RIFF": _wave, b"RF64": _wave, b"DSD ": _dsf, b"FRM8": _dff}


def probe(source: bytes | str | Path) -> dict | None:
    """The layout of a file, or of its content, by its headers; None if it is opaque. Errors of reading are raised."""
    with Reader(source) as r:
        try:
            magic = r.read(0, 4)
            info = PROBES[magic](r) if magic in PROBES else None
            return info if info and valid(info, r.size) else None
        except (_Bad, struct.error, IndexError):
            return None


def valid(info: dict, size: int) -> bool:
    """Whether a layout's fields agree with each other and with a file of this size."""
    if not isinstance(info, dict) or set(info) != set(KEYS) or any(type(info[k]) is not (str if k in ("container", "kind", "bit_order") else int) for k in KEYS):
        return False
    c, n, w, at, length = (info[k] for k in ("channels", "frames", "width", "data_offset", "data_size"))
    if any(not 0 <= info[k] < 1 << 63 for k in KEYS if type(info[k]) is int) or not (1 <= c <= 8 and n > 0 and 0 < info["rate"] < 1 << 32 and length > 0 and at + length <= size):
        return False
    if info["kind"] == "pcm":
        return info["container"] in ("wav", "rf64") and w in (2, 3, 4) and 0 < info["valid_bits"] <= 8 * w and length == n * c * w and at >= (44 if info["container"] == "wav" else 80) and info["bit_order"] == "msb" and info["block_size"] == 0
    if info["kind"] != "dsd" or w != 1 or info["valid_bits"] != 1:
        return False
    if info["container"] == "dsf":
        return c <= 6 and info["block_size"] == BLOCK and info["bit_order"] in ("lsb", "msb") and length == -(-(-(-n // 8)) // BLOCK) * BLOCK * c and at >= 92
    return info["container"] == "dff" and n % 8 == 0 and length == n // 8 * c and at >= 16 and info["bit_order"] == "msb" and info["block_size"] == 0


def channel_size(info: dict) -> int:
    return info["frames"] * info["width"] if info["kind"] == "pcm" else -(-info["frames"] // 8)


def _step(info: dict, channel: int, chunk: int) -> int:
    """Bytes of a channel to go by at a time: whole samples, within the bounds."""
    if type(channel) is not int or not 0 <= channel < info["channels"] or type(chunk) is not int or not info["width"] <= chunk <= MOST_READ:
        raise ValueError("no such channel, or not a length to read by")
    return chunk - chunk % info["width"]


def _extents(info: dict, channel: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(place in the file, bytes there, step, unit) of n bytes of a channel: whole runs in DSF, strided units elsewhere."""
    c, w, start = info["channels"], info["width"], info["data_offset"]
    if info["container"] != "dsf":
        yield start + at * c, n * c, c * w, w
        return
    while n:
        group, inside = divmod(at, BLOCK)
        part = min(n, BLOCK - inside)
        yield start + (group * c + channel) * BLOCK + inside, part, 0, part
        at, n = at + part, n - part


def iter_channel(source: bytes | str | Path, info: dict, channel: int, chunk: int = READ) -> Iterator[bytes]:
    """A channel's bytes in order, first bit first for 1-bit samples, of at most `chunk` bytes each; `channels * chunk` bytes of the file are held at most."""
    step, size = _step(info, channel, chunk), channel_size(info)
    with Reader(source) as r:
        if not valid(info, r.size):
            raise ValueError("not the layout of this file")
        for at in range(0, size, step):
            parts = []
            for place, n, stride, unit in _extents(info, channel, at, min(step, size - at)):
                own = np.frombuffer(r.read(place, n), np.uint8)
                parts.append(own.reshape(-1, stride)[:, channel * unit : (channel + 1) * unit].ravel() if stride else own)
            out = np.concatenate(parts)
            yield (REVERSED[out] if info["bit_order"] == "lsb" else out).tobytes()


def read_channel(data: bytes, info: dict, channel: int) -> bytes:
    """All of a channel's bytes."""
    return b"".join(iter_channel(data, info, channel))


def write_channel(target: np.ndarray, info: dict, channel: int, data: bytes, at: int = 0) -> None:
    """Puts some of a channel's bytes, whole samples from `at` on, where they belong in a file's bytes. Nothing is written unless all fits."""
    own = np.frombuffer(data, np.uint8)
    if not valid(info, len(target)) or not 0 <= channel < info["channels"] or at < 0 or at % info["width"] or len(own) % info["width"] or at + len(own) > channel_size(info):
        raise ValueError("not the bytes of a channel")
    own = REVERSED[own] if info["bit_order"] == "lsb" else own
    done = 0
    for place, n, stride, unit in _extents(info, channel, at, len(own)):
        if stride:
            target[place : place + n].reshape(-1, stride)[:, channel * unit : (channel + 1) * unit] = own.reshape(-1, unit)
        else:
            target[place : place + n] = own[done : done + n]
            done += n


def raw_spans(info: dict | None, size: int) -> list[tuple[int, int]]:
    """(offset, length) of the bytes that no channel owns, in order, none empty or adjacent."""
    if info is None:
        return [(0, size)] if size else []
    start, end = info["data_offset"], info["data_offset"] + info["data_size"]
    edges = [0, start]
    if info["container"] == "dsf" and (used := channel_size(info) % BLOCK):
        # Each channel's last block is padded.
        first = end - info["channels"] * BLOCK
        for channel in range(info["channels"]):
            edges += [first + channel * BLOCK + used, first + (channel + 1) * BLOCK]
    edges += [end, size]
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if out and sum(out[-1]) == a:
            out[-1] = out[-1][0], b - out[-1][0]
        elif a < b:
            out.append((a, b - a))
    return [(a, n) for a, n in out if n]
