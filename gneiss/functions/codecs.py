"""Codecs of stored objects: raw, zlib and LZMA; decoding is strict and bounded."""

from __future__ import annotations

import lzma
import zlib

#: The most bytes of an object, what an encoding may add, and the memory of an LZMA decoder.
LARGEST, SPARE, LZMA_MEMORY = 8 << 20, 64 << 10, 64 << 20


class CodecError(ValueError):
    """An object that does not decode to exactly what was stored."""


def encode(data: bytes, kind: str = "raw", width: int = 1) -> tuple[str, bytes]:
    """The smallest of raw, zlib level 6 and, from 256 bytes on, LZMA preset 3; the first of equals. kind and width say what the bytes are: whole samples of 2 to 4 bytes for pcm, else bytes."""
    if kind not in ("raw", "pcm", "dsd") or type(width) is not int or (width not in (2, 3, 4) or len(data) % width if kind == "pcm" else width != 1):
        raise CodecError("unknown kind, or a width that is not the kind's")
    if len(data) > LARGEST:
        raise CodecError("an object has 8 MiB at most")
    choices = [("raw", data), ("zlib", zlib.compress(data, 6))]
    if len(data) >= 256:
        choices.append(("lzma", lzma.compress(data, preset=3)))
    codec, encoded = min(choices, key=lambda c: len(c[1]))
    if decode(encoded, codec, len(data)) != data:
        raise CodecError("an encoding does not restore its object")
    return codec, encoded


def decode(encoded: bytes, codec: str, size: int, width: int = 1) -> bytes:
    """The object's bytes: exactly `size`, from exactly one complete stream. All codecs here are of bytes, of width 1."""
    if type(size) is not int or type(width) is not int or width != 1:
        raise CodecError("a size and the width 1 are needed")
    if not 0 <= size <= LARGEST or len(encoded) > LARGEST + SPARE:
        raise CodecError("sizes out of range")
    if codec == "raw":
        data, whole = encoded, True
    elif codec in ("zlib", "lzma"):
        try:
            machine = zlib.decompressobj() if codec == "zlib" else lzma.LZMADecompressor(format=lzma.FORMAT_XZ, memlimit=LZMA_MEMORY)
            data = machine.decompress(encoded, size + 1)
            if len(data) == size and not machine.eof:
                data += machine.decompress(machine.unconsumed_tail if codec == "zlib" else b"", 1)
            whole = machine.eof and not machine.unused_data
        except (zlib.error, lzma.LZMAError, EOFError) as e:
            raise CodecError(f"{codec}: {e}") from e
    else:
        raise CodecError(f"unknown codec {codec}")
    if not whole or len(data) != size:
        raise CodecError("a stream is incomplete, too long, or followed by more")
    return data


def require(codec: str) -> None:
    """CodecError if a codec cannot be used here."""
    if not available().get(codec):
        raise CodecError(f"codec {codec} is not available")


def available() -> dict[str, bool]:
    """Codecs that can be used here; external audio coders are not part of this engine."""
    return {"raw": True, "zlib": True, "lzma": True}
