"""Golomb-coded exchange of sorted hashes between blocks of rows and hash owners.

Every block of rows sends each owner, which is responsible for one equal range of hash values, its sorted distinct
hashes of that range as Golomb-Rice codes. An owner sees all blocks' hashes of its range and sends each block flags for
them, a bitmap per flag. Nothing but codes and bitmaps is shuffled, no task sees more than one range or one block, and
a hash that a third of all rows hold takes one code per block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Up to how many blocks their keys are chosen so that Spark deals out one to a task; beyond, they are numbered.
MOST_EVEN = 10_000
#: Width of exchanged hashes, and to how many low bits the owners' ranges are aligned.
BITS, ALIGN = 60, 28
SENT = "block long, owner long, n long, codes binary"
JUDGED = "block long, owner long, n long, flags binary"


def rice_encode(values: np.ndarray, universe: int) -> bytes:
    """Golomb-Rice codes of sorted distinct values below `universe`: parameter, unary quotients of the gaps, then fixed-width remainders."""
    n = len(values)
    if not n:
        return b"\0"
    gaps = np.diff(values.astype(U), prepend=U(0))
    width = max(0, int(np.log2(max(1.0, 0.69 * universe / n))))
    quotient = (gaps >> U(width)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    rest = gaps & U((1 << width) - 1)
    bits = ((rest[:, None] >> np.arange(width, dtype=U)[None, :]) & U(1)).astype(np.uint8) if width <= 8 else None
    if bits is None:
        low = width % 8
        whole = (rest >> U(low)).astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width // 8 :]
        tail = np.packbits(((rest[:, None] >> np.arange(low, dtype=U)[None, :]) & U(1)).astype(np.uint8).ravel()).tobytes() if low else b""
        rests = whole.tobytes() + tail
    else:
        rests = np.packbits(bits.ravel()).tobytes()
    head = np.array([width, len(unary)], dtype="<i8").tobytes()
    return b"\1" + head + np.packbits(unary).tobytes() + rests


def rice_decode(codes: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, dtype=U)
    width, size = np.frombuffer(codes, dtype="<i8", count=2, offset=1)
    width, size, at = int(width), int(size), 17
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(codes, np.uint8, (size + 7) // 8, at), count=size))
    quotient = np.diff(ends, prepend=-1) - 1
    at += (size + 7) // 8
    if width <= 8:
        rest = _low(codes, at, n, width)
    else:
        low, whole = width % 8, width // 8
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, 8 - whole :] = np.frombuffer(codes, np.uint8, n * whole, at).reshape(n, whole)
        rest = (full.view(">u8").ravel().astype(U) << U(low)) | _low(codes, at + n * whole, n, low)
    return np.cumsum((quotient.astype(U) << U(width)) | rest, dtype=U)


def _low(codes: bytes, at: int, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, dtype=U)
    bits = np.unpackbits(np.frombuffer(codes, np.uint8, (n * width + 7) // 8, at), count=n * width).reshape(n, width)
    return (bits.astype(U) << np.arange(width, dtype=U)).sum(axis=1, dtype=U)


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of longs (Murmur3 with seed 42)."""

    def turn(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    h = np.full(len(x), 42, dtype=np.uint32)
    for half in ((x & 0xFFFFFFFF), (x >> 32) & 0xFFFFFFFF):
        k = turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


def even_keys(n: int) -> np.ndarray:
    """n keys, the i-th of which Spark's hash partitioning sends to partition i of n: blocks and owners are dealt out one to a task."""
    found = np.full(n, -1, dtype=np.int64)
    start, step = 0, max(1024, 4 * n)
    while (found < 0).any():
        x = np.arange(start, start + step, dtype=np.int64)
        part, first = np.unique(np.mod(_spark_hash(x).astype(np.int64), n), return_index=True)
        free = found[part] < 0
        found[part[free]] = x[first[free]]
        start += step
    return found


def width_of(spark: SparkSession) -> int:
    """Number of blocks and of owners: the cluster's shuffle partitions, which follow the input's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_keys(n: int) -> np.ndarray:
    """The keys of n blocks, or owners, in order; all that names a block or an owner takes them from here."""
    return even_keys(n) if n <= MOST_EVEN else np.arange(n, dtype=np.int64)


def by_hash(spark: SparkSession, *columns: Column | str, blocks: int | None = None) -> Column:
    """Block key of a row, spread by the columns' values. Rows that differ in any of them are dealt out apart."""
    n = blocks or width_of(spark)
    number = F.pmod(F.xxhash64(*columns), F.lit(n))
    if n > MOST_EVEN:
        return number
    keys = F.split(F.lit(",".join(map(str, block_keys(n)))), ",")  # folded to one constant
    return F.element_at(keys, (number + 1).cast("int")).cast("long")


def send(block: int, hashes: np.ndarray, owners: int, keys: np.ndarray, bits: int = BITS, counts: np.ndarray | None = None) -> pa.Table:
    """A block's message to each owner; hashes are sorted, distinct and of `bits` bits. With counts, one for each hash, these follow the codes."""
    edges = ((np.arange(owners + 1, dtype=object) * (1 << bits)) // owners >> ALIGN) << ALIGN
    cut = np.searchsorted(hashes, np.array([min(int(e), (1 << bits) - 1) for e in edges[:-1]], dtype=U))
    cut = np.append(cut, len(hashes))
    rows = [(block, int(keys[i]), int(b - a), rice_encode(hashes[a:b] - U(int(edges[i])), int(edges[i + 1] - edges[i])), *([pack_counts(counts[a:b])] if counts is not None else [])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    fields = [("block", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("codes", pa.binary())] + ([("counts", pa.binary())] if counts is not None else [])
    return pa.table(list(map(list, zip(*rows, strict=True))) if rows else [[]] * len(fields), schema=pa.schema(fields))


def judge(sent: DataFrame, keys: np.ndarray, rule: Callable[[list[np.ndarray]], list[list[np.ndarray]]], carried: str | None = None) -> DataFrame:
    """What the owners say. carried: a binary column of the messages that goes back to the blocks as it is. rule(arrays) gets the sorted hashes of each block, blocks in the order of their keys, less the range's start, and returns for each block one boolean array per flag."""

    def decide(table: pa.Table) -> pa.Table:
        place = {int(k): i for i, k in enumerate(keys)}
        table = table.combine_chunks()
        table = table.take(np.argsort([place[b] for b in table["block"].to_pylist()]))
        counts, codes = table["n"].to_pylist(), table["codes"].to_pylist()
        flags = rule([rice_decode(c, n) for c, n in zip(codes, counts, strict=True)])
        packed = [b"".join(np.packbits(f).tobytes() for f in each) for each in flags]
        out = pa.table([table["block"], table["owner"], table["n"], pa.array(packed, pa.binary())], names=["block", "owner", "n", "flags"])
        return out.append_column(carried, table[carried]) if carried else out

    return sent.groupBy("owner").applyInArrow(decide, JUDGED + (f", {carried} binary" if carried else ""))


def told(table: pa.Table, keys: np.ndarray, flags: int) -> list[np.ndarray]:
    """A block's flags in the order of the sorted hashes that it sent."""
    order = {int(k): i for i, k in enumerate(keys)}
    rows = sorted(zip((order[k] for k in table["owner"].to_pylist()), table["n"].to_pylist(), table["flags"].to_pylist(), strict=True), key=lambda r: r[0])
    out: list[list[np.ndarray]] = [[] for _ in range(flags)]
    for _, n, packed in rows:
        size = (n + 7) // 8
        for k in range(flags):
            out[k].append(np.unpackbits(np.frombuffer(packed, np.uint8, size, k * size), count=n).astype(bool))
    return [np.concatenate(x) if x else np.empty(0, bool) for x in out]


def _flat(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    every = np.concatenate(arrays) if arrays else np.empty(0, dtype=U)
    order = np.argsort(every, kind="stable")
    return every, order, every[order]


def _split(flag: np.ndarray, arrays: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(flag, np.cumsum([len(a) for a in arrays])[:-1])


def pack_counts(x: np.ndarray) -> bytes:
    """Counts, a byte each if under 255."""
    x = x.astype(np.int64)
    large = x[x >= 255]
    return len(large).to_bytes(8, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    many = int.from_bytes(packed[:8], "little")
    x = np.frombuffer(packed, np.uint8, n, 8).astype(np.int64)
    x[x == 255] = np.frombuffer(packed, "<i8", many, 8 + n)
    return x


def elsewhere(arrays: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rule with one flag: another block has the hash too."""
    every, order, ordered = _flat(arrays)
    same = ordered[1:] == ordered[:-1]
    flag = np.zeros(len(every), bool)
    flag[order] = np.append(same, False) | np.append(False, same) if len(every) else False
    return [[f] for f in _split(flag, arrays)]


def earlier(arrays: list[np.ndarray], table: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[np.ndarray]]:
    """Rule with one flag: a block of smaller number has the hash. The shards' sorted arrays are merged once, and each is looked up in the merged array by binary search."""
    merged, first = table or _merged(arrays)
    return [[first[np.searchsorted(merged, a)] < i] for i, a in enumerate(arrays)]


def _merged(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, order, ordered = _flat(arrays)
    number = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(every) else np.empty(0, bool)
    return ordered[new], number[new]


def segment_rule(low_bits: int, by_order: bool) -> Callable[[list[np.ndarray]], list[list[np.ndarray]]]:
    """Rule with two flags for hashes that end in `low_bits` bits of a text around an anchor, the bits above being the anchor's: the same hash is in another block (or, by order, in an earlier one); and the anchor also occurs in another text."""

    def rule(arrays: list[np.ndarray]) -> list[list[np.ndarray]]:
        table = _merged(arrays)
        merged = table[0]
        anchor = merged >> U(low_bits)
        same = anchor[1:] == anchor[:-1]
        varied = (np.append(same, False) | np.append(False, same)) if len(merged) else np.empty(0, bool)
        known = earlier(arrays, table) if by_order else elsewhere(arrays)
        return [[k[0], varied[np.searchsorted(merged, a)]] for k, a in zip(known, arrays, strict=True)]

    return rule
