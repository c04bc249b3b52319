"""Suffix-array dedup: bytes that an earlier document already has go.

Documents are dealt into shards by ranges of their ids. Anchors, chosen by content as in substring_dedup, tell the
stretches of text whose surroundings occur once (nothing to do), those that an earlier shard or document has whole
(removed), and the rest. For the rest each shard builds a suffix array by Larsson-Sadakane refinement, takes common
prefixes by Kasai's rule, and so finds the distinct strings of the window's length and the earliest of its documents
that has each. Shards are merged by binary search: an owner of a range of the strings' hashes looks each shard's sorted
array up in the merged one, which knows the first shard of each string. What a shard found before it asked is sent along
and comes back with the answer, so no array is built twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import exchange as ex
from gneiss.llm import textbytes as tb
from gneiss.llm.substring_dedup import LOW, Segments, _ranges, _varied, segments

U = np.uint64
LAST = np.iinfo(np.int64).max
#: Bytes that a suffix array is built over, about.
PART = 1 << 19


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` bytes at least, and each suffix's rank. Larsson-Sadakane: sort by a first key, then only groups that still tie are sorted by the rank of what follows, at twice the distance each time."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(U)
    key = np.zeros(n, dtype=U)
    for j in range(8):
        key = (key << U(8)) | padded[j : j + n]
    # A suffix shorter than the key has zeros for its missing bytes; the shorter one comes first as its text ends earlier.
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n + depth * 2 + 8, dtype=np.int64)
    rank[n:] = 0
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n))) + 1
    h = 8
    while h < depth:
        size = np.diff(np.append(starts, n))
        many = np.repeat(size > 1, size)
        at = np.flatnonzero(many)
        if not len(at):
            break
        group, suffix = rank[order[at]], order[at]
        pair = (group.astype(U) << U(32)) | rank[suffix + h].astype(U)
        again = np.argsort(pair, kind="stable")
        order[at] = suffix[again]
        pair = pair[again]
        new[at] = np.append(True, pair[1:] != pair[:-1])
        starts = np.flatnonzero(new)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n))) + 1
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, stretch: int = 128) -> np.ndarray:
    """Length, up to cap, that each suffix in order shares with the one before it. Kasai's rule, from one suffix of the text to the next the length falls by one at most, is followed in many stretches of the text side by side. Suffixes that tie stand in any order; where the next pair stands in the wrong one, counting starts anew."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(n + 1, n, dtype=np.int64)
    place[order] = np.arange(n)
    padded = np.concatenate((text.astype(np.int16), np.full(cap + 1, -1, np.int16)))
    out = np.zeros(n, dtype=np.int32)
    at = np.arange(0, n, stretch)
    end = np.minimum(at + stretch, n)
    have = np.zeros(len(at), dtype=np.int64)
    while len(at):
        other = before[at]
        longer = (other >= 0) & (have < cap)
        left, right = padded[at + have], padded[other + have]
        longer &= (left == right) & (left >= 0)
        have += longer
        done = ~longer
        out[at[done]] = have[done]
        at[done] += 1
        anew = place[other + 1] > place[at]
        have[done] = np.where(anew, 0, np.maximum(have - 1, 0))[done]
        if (over := at >= end).any():
            at, end, have = at[~over], end[~over], have[~over]
    rows = out[order]
    rows[0:1] = 0
    return rows


def ordered_blocks(docs: DataFrame, ids: str) -> Column:
    """Block key of a row such that later blocks hold larger ids. The ids' quantiles, one per block, come to the driver; nulls are last."""
    spark = docs.sparkSession
    n = ex.width_of(spark)
    keys = ex.block_keys(n)
    bounds = np.array(docs.approxQuantile(ids, [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], dtype=np.float64)
    bounds = np.unique(bounds)

    @F.pandas_udf("long")
    def block(number: pd.Series) -> pd.Series:
        return pd.Series(keys[np.searchsorted(bounds, number.to_numpy(dtype=np.float64), side="right")])

    return block(F.coalesce(F.col(ids), F.lit(LAST)))


class Shard:
    """A block's texts, in order of id, with what is known of their segments."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        self.window = window
        self.data, self.offsets = tb.texts(self.table["text"])
        ids = self.table["id"].to_numpy()
        self.rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)

    def cut(self) -> Segments:
        """The texts' segments."""
        parts, window = [], self.window
        for a, b in tb.pieces(self.offsets):
            limits = self.offsets[a : b + 1] - self.offsets[a]
            s = segments(tb.prefix(tb.byte_values(self.data[self.offsets[a] : self.offsets[b]])), limits, window, (window + 2) // 2)
            parts.append(Segments(s.key, s.doc + a, s.first + self.offsets[a], s.end + self.offsets[a]))
        return Segments(*(np.concatenate([getattr(p, f) for p in parts]) if parts else np.empty(0, U if f == "key" else np.int64) for f in ("key", "doc", "first", "end")))

    def resolve(self, flags: pa.Table, keys: np.ndarray) -> None:
        """Runs that go as an earlier document has their segments whole or an earlier one of the shard their windows; and of the rest its stretches and its distinct windows' hashes, by the array of its suffixes."""
        s = self.cut()
        distinct, at, place = np.unique(s.key, return_index=True, return_inverse=True)
        known, varied = ex.told(flags, keys, 2)
        # Texts are in order of rank, so the first place of a segment or window has its least rank.
        rank = self.rank[s.doc]
        known = known[place] | (rank > rank[at][place])
        rest = (varied | _varied(distinct))[place] & ~known
        rank = np.repeat(rank[rest], s.end[rest] - s.first[rest])
        # Segments side by side are one stretch of text.
        starts, ends = s.first[rest], s.end[rest]
        new = np.append(True, starts[1:] != ends[:-1]) if len(starts) else np.empty(0, bool)
        starts, ends = starts[new], ends[np.append(new[1:], True)] if len(new) else ends
        self.open = starts, ends
        # Arrays of suffixes are built for parts of bounded size; their distinct strings meet in one sorted array of hashes.
        part = np.cumsum(ends - starts + self.window - 1) // PART
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(starts)) if len(starts) else np.zeros(1, np.int64)
        found = [self.strings(starts[i:j], ends[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        hashed = np.concatenate([h for h, _ in found] or [np.empty(0, U)])
        at = np.cumsum([0] + [len(h) for h, _ in found])
        of = np.concatenate([o + i for (_, o), i in zip(found, at, strict=False)] or [np.empty(0, np.int64)])
        self.hashes, back = np.unique(hashed, return_inverse=True)
        of = back[of]
        least = np.empty(len(self.hashes), np.int32)
        least[of[::-1]] = rank[::-1]
        single = _ranges(starts, ends)[rank > least[of]]
        self.gone = tb.union(np.concatenate((s.first[known], single)), np.concatenate((s.end[known] + self.window - 1, single + self.window)))

    def state(self) -> bytes:
        """What resolve() found, for remember(): the places of runs and stretches."""
        return b"".join(len(a).to_bytes(8, "little") + a.astype("<i8").tobytes() + b.astype("<i8").tobytes() for a, b in (self.gone, self.open))

    def remember(self, state: bytes) -> None:
        """The runs and stretches again, and the hash of each window of these."""
        both, at = [], 0
        for _ in range(2):
            n = int.from_bytes(state[at : at + 8], "little")
            both.append(np.frombuffer(state, "<i8", 2 * n, at + 8).reshape(2, n))
            at += 8 + 16 * n
        self.gone, self.open = both
        starts, ends = self.open
        found = [np.empty(0, U)]
        for a, b in tb.pieces(self.offsets):
            # No stretch crosses texts.
            low, high = self.offsets[a], self.offsets[b]
            i, j = np.searchsorted(starts, (low, high))
            if i < j:
                window = _ranges(starts[i:j], ends[i:j]) - low
                found.append(tb.span(tb.prefix(tb.byte_values(self.data[low:high])), window, window + self.window) >> U(64 - ex.BITS))
        self.hashes = np.concatenate(found)

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each distinct window of some stretches, and each window's number among them."""
        text, at = tb.gather(self.data, starts, ends + self.window - 1)
        valid = _ranges(at[:-1], at[:-1] + ends - starts)
        order, _ = suffix_array(text, self.window)
        kind = np.empty(len(text), dtype=np.int32)
        kind[order] = np.cumsum(common_prefixes(text, order, self.window) < self.window)
        used, one, of = np.unique(kind[valid], return_index=True, return_inverse=True)
        one = valid[one]
        return tb.span(tb.prefix(tb.byte_values(text)), one, one + self.window) >> U(64 - ex.BITS), of


SCHEMA = "id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"


def earlier_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, kept (the remaining bytes), spans (start and end of each removed run).

    A byte goes if a string of `window` bytes over it also starts in a document with a smaller id; strings are judged on
    the input. Null texts are empty. Documents with equal ids, repeated rows among them, do not count as smaller. A null
    id counts as larger than all others. kept may cut a character in two, so it is binary.
    """
    if window < 2:
        raise ValueError("window must be 2 bytes at least")
    spark = docs.sparkSession
    n, keys = ex.width_of(spark), ex.block_keys(ex.width_of(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = rows.withColumn("block", ordered_blocks(rows.select("id"), "id")).repartition(n, "block")

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return ex.send(key[0].as_py(), np.unique(Shard(_dated(table), window).cut().key), n, keys)

    def second(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        """The open windows' hashes; one message, to another owner for each block, carries what the block needs again, and it comes back as it is."""
        block, none = key[0].as_py(), np.empty(0, U)
        if not table.num_rows:
            return ex.send(block, none, n, keys).append_column("state", pa.array([], pa.binary()))
        shard = Shard(_dated(table), window)
        shard.resolve(flags, keys)
        sent = ex.send(block, shard.hashes, n, keys)
        own = int(np.flatnonzero(keys == block)[0])
        if not sent.num_rows:
            sent = pa.table([[block], [int(keys[own])], [0], [ex.rice_encode(none, 1)]], schema=sent.schema)
        state = shard.state()
        return sent.append_column("state", pa.array([state if i == own % sent.num_rows else None for i in range(sent.num_rows)], pa.binary()))

    def last(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * 5, schema=OUT)
        shard = Shard(_dated(table), window)
        shard.remember(next(x for x in flags["state"].to_pylist() if x is not None))
        told = ex.told(flags.filter(pc.greater(flags["n"], 0)), keys, 1)[0]
        starts, ends = shard.gone
        if len(shard.hashes):
            single = _ranges(*shard.open)[told[np.unique(shard.hashes, return_inverse=True)[1]]]
            starts, ends = tb.union(np.concatenate((starts, single)), np.concatenate((ends, single + window)))
        gone = np.zeros(len(shard.data) + 1, np.int8)
        gone[starts], gone[ends] = 1, -1
        gone = np.cumsum(gone, dtype=np.int8)[:-1].view(bool)
        ids, size, removed, kept, spans = shard.table["id"].to_pylist(), [], [], [], []
        for i, (a, b) in enumerate(zip(shard.offsets[:-1], shard.offsets[1:], strict=True)):
            own = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            size.append(int(b - a))
            removed.append(int(own.sum()))
            kept.append(shard.data[a:b][~own].tobytes())
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            ids[i] = None if ids[i] == LAST else ids[i]
        return pa.table([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, OUT.field("spans").type)], schema=OUT)

    one = ex.judge(blocks.groupBy("block").applyInArrow(first, ex.SENT), keys, ex.segment_rule(LOW, by_order=True))
    resolved = blocks.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(second, ex.SENT + ", state binary")
    two = ex.judge(resolved, keys, ex.earlier, carried="state")
    return blocks.groupBy("block").cogroup(two.groupBy("block")).applyInArrow(last, SCHEMA).withColumnRenamed("id", id_col)


OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _dated(table: pa.Table) -> pa.Table:
    """Null ids become the largest."""
    return table.set_column(table.schema.get_field_index("id"), "id", table["id"].fill_null(LAST))
