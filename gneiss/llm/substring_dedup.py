"""Substring dedup by level-wise doubling over words.

Level 1 looks at windows of half the length (rounded up) at content-chosen anchors only: the least-hashed such window
of every full window, so that equal full windows have equal anchors. Each run of full windows with one anchor is a
segment. An owner of hashes says of each segment whether the same segment occurs elsewhere, and whether its anchor
occurs in another segment. Anchors that occur alone end there. Where segments are equal, so are all their windows.
Only what is left, repeated anchors in differing segments, is extended to full windows, exchanged one by one. What words
are removed is decided at that level. Runs of repeated windows that hold one of twice the length go on as stretches of
word hashes, and the same two steps are taken on them at twice the length, four times, and so on, until no candidates
survive: each text's longest length that repeats is known then.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import exchange as ex
from gneiss.llm import textbytes as tb
from gneiss.llm.work import written

U = np.uint64
LOW = ex.ALIGN  # bits of a segment's hash beside its anchor's
#: Bytes of stretches in a block, about.
BLOCK = 4 << 20


@dataclass
class Segments:
    """Runs of windows with one anchor: hash, text's number, first window, and the one after the last."""

    key: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    end: np.ndarray


def segments(sums: np.ndarray, limits: np.ndarray, width: int, part: int) -> Segments:
    """Of all windows of `width` values that lie in one text; limits: where each text begins, and the end. part: the anchors' width."""
    spread = width - part + 1
    n = len(sums) - 1 - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return Segments(np.empty(0, U), none, none, none)
    grams = tb.rolling(sums, part, mixed=False)
    if len(grams) >= 1 << 28:
        raise ValueError("a text may have 2**28 words or bytes at most")
    ranked = grams & U(~((1 << 28) - 1) & ((1 << 64) - 1))
    ranked |= np.arange(len(grams), dtype=U)
    anchor = (tb.sliding_min(ranked, spread) & U((1 << 28) - 1)).astype(np.int64)[:n]
    sizes = np.maximum(0, np.diff(limits) - width + 1)
    docs = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(docs)) + np.repeat(limits[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    anchors = anchor[at]
    new = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (docs[1:] != docs[:-1]))) if len(at) else np.empty(0, np.int64)
    first = at[new]
    end = at[np.append(new[1:], len(at)) - 1] + 1 if len(at) else first
    whole = tb.span(sums, first, end + width - 1) ^ tb.mix((anchors[new] - first).astype(U) * U(0x9E3779B97F4A7C15) + (end - first).astype(U))
    # An anchor is the least of its surroundings; mixed again, its hash is spread evenly over the owners.
    key = ((tb.mix(tb.mix(grams[anchors[new]])) >> U(64 - (ex.BITS - LOW))) << U(LOW)) | (tb.mix(whole) >> U(64 - LOW))
    return Segments(key, docs[new], first, end)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size)


class Piece:
    """Some whole texts of a block as words; `limits`: words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window = data, window
        self.starts, self.ends, self.limits = tb.words(data, offsets)
        self.hashes = tb.word_hashes(data, self.starts, self.ends)
        self.sums = tb.prefix(self.hashes)
        self.segments = segments(self.sums, self.limits, window, (window + 1) // 2)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window of the chosen segments."""
        s = self.segments
        at = _ranges(s.first[chosen], s.end[chosen])
        return at, tb.span(self.sums, at, at + self.window) >> U(64 - ex.BITS)


def _texts(table: pa.Table, ids: str, text: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's rows in a fixed order, whatever order they arrive in."""
    table = table.combine_chunks().sort_by([(ids, "ascending"), (text, "ascending")])
    return table, *tb.texts(table[text])


def _local(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and how often each occurs."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def _varied(distinct: np.ndarray) -> np.ndarray:
    anchor = distinct >> U(LOW)
    same = anchor[1:] == anchor[:-1]
    return np.append(same, False) | np.append(False, same) if len(distinct) else np.empty(0, bool)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_text, spans (start and end word of each removed run).

    A word goes if a window of `window` words over it also starts at any other place of any text; windows are judged on
    the input. A null or empty text has no words. Rows with equal ids are texts of their own, and a repeated row
    repeats all its windows. A null id is an id like another. Other columns of docs are not looked at. Spaces that
    separate words become one space in kept_text.
    """
    return _windows(docs, id_col, text_col, window).drop("row", "longer")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> tuple[DataFrame, DataFrame]:
    """What repeated_words() returns, with a key (row) of each row's id and text; and (row, longest) of the rows with repeats: the largest of window, 2 * window, 4 * window and so on of which the text has a run of words that also starts elsewhere."""
    done = written(_windows(docs, id_col, text_col, window), "windows")
    found = [done.where("n_removed > 0").select("row", F.lit(window).cast("long").alias("longest"))]
    left = written(done.select("row", F.explode("longer").alias("words")), "stretches")
    while (size := left.agg(F.sum(F.octet_length("words"))).first()[0]) is not None:
        window *= 2
        level = written(_doubled(left, window, max(1, min(ex.width_of(docs.sparkSession), -(-size // BLOCK)))), "level")
        found.append(level.select("row", F.lit(window).cast("long").alias("longest")))
        left = level.where("words is not null")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return done.drop("longer"), written(every.groupBy("row").agg(F.max("longest").alias("longest")), "longest")


def _runs(repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], repeated.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _doubled(stretches: DataFrame, window: int, n: int) -> DataFrame:
    """Of stretches (row, words: hashes of words), one row for each run of repeated windows: row, and the run's words if they hold a window of twice the length."""
    spark, keys = stretches.sparkSession, ex.block_keys(n)
    blocks = stretches.withColumn("block", ex.by_hash(spark, "row", "words", blocks=n)).repartition(n, "block")

    def parsed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
        data, offsets = tb.texts(table["words"])
        words, limits = np.frombuffer(data.tobytes(), dtype=U), offsets // 8
        sums = tb.prefix(words)
        return words, limits, sums, segments(sums, limits, window, window // 2)

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return ex.send(key[0].as_py(), np.unique(parsed(table)[3].key), n, keys)

    def resolve(table: pa.Table, flags: pa.Table) -> tuple:
        words, limits, sums, s = parsed(table)
        distinct, place, count = _local(s.key)
        known, varied = ex.told(flags, keys, 2)
        known = (known | (count > 1))[place]
        varied = (varied | _varied(distinct))[place]
        at = _ranges(s.first[varied], s.end[varied])
        return words, limits, s, known, at, tb.span(sums, at, at + window) >> U(64 - ex.BITS)

    def second(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ex.send(key[0].as_py(), np.empty(0, U), n, keys)
        return ex.send(key[0].as_py(), np.unique(resolve(table, flags)[-1]), n, keys)

    def last(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[], []], schema=STRETCHES)
        level = flags["level"].to_numpy()
        words, limits, s, known, at, hashes = resolve(table, flags.filter(pa.array(level == 1)))
        distinct, place, count = _local(hashes)
        again = ((count > 1) | ex.told(flags.filter(pa.array(level == 2)), keys, 1)[0])[place]
        repeated = np.zeros(len(words), dtype=bool)
        repeated[_ranges(s.first[known], s.end[known])] = True
        repeated[at[again]] = True
        starts, ends = _runs(repeated)
        rows = table["row"].combine_chunks().take(pa.array(np.searchsorted(limits, starts, side="right") - 1))
        longer = [words[a : b + window - 1].tobytes() if b - a > window else None for a, b in zip(starts, ends, strict=True)]
        return pa.table([rows, pa.array(longer, pa.binary())], schema=STRETCHES)

    one = ex.judge(blocks.groupBy("block").applyInArrow(first, ex.SENT), keys, ex.segment_rule(LOW, by_order=False))
    two = ex.judge(blocks.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(second, ex.SENT), keys, ex.elsewhere)
    both = one.withColumn("level", F.lit(1)).unionByName(two.withColumn("level", F.lit(2)))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(last, "row long, words binary")


STRETCHES = pa.schema([("row", pa.int64()), ("words", pa.binary())])


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """What repeated_words() returns, with `row` and `longer`: the word hashes of runs that hold a repeated window of twice the length, perhaps."""
    if window < 2:
        raise ValueError("window must be 2 words at least")
    spark = docs.sparkSession
    n, keys = ex.width_of(spark), ex.block_keys(ex.width_of(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    blocks = rows.withColumn("block", ex.by_hash(spark, "id", "text")).repartition(n, "block")

    def first(key: tuple, table: pa.Table) -> pa.Table:
        _, data, offsets = _texts(table, "id", "text")
        found = [Piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window).segments.key for a, b in tb.pieces(offsets)]
        return ex.send(key[0].as_py(), np.unique(np.concatenate(found or [np.empty(0, U)])), n, keys)

    def resolve(table: pa.Table, flags: pa.Table) -> tuple:
        """Of each piece of the block, the segments that repeat as a whole and those to look at window by window."""
        table, data, offsets = _texts(table, "id", "text")
        cuts = list(tb.pieces(offsets))
        key = [Piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window).segments.key for a, b in cuts]
        distinct, place, count = _local(np.concatenate(key or [np.empty(0, U)]))
        known, varied = ex.told(flags, keys, 2)
        known |= count > 1
        known, varied = known[place], (varied | _varied(distinct))[place]
        at = np.cumsum([0, *map(len, key)])
        return table, data, offsets, [(a, b, known[i:j], varied[i:j]) for (a, b), i, j in zip(cuts, at[:-1], at[1:], strict=True)]

    def windows_of(data: np.ndarray, offsets: np.ndarray, cuts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        return [Piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window).windows(varied) for a, b, _, varied in cuts]

    def second(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ex.send(key[0].as_py(), np.empty(0, U), n, keys)
        _, data, offsets, cuts = resolve(table, flags)
        hashes = [h for _, h in windows_of(data, offsets, cuts)]
        return ex.send(key[0].as_py(), np.unique(np.concatenate(hashes)), n, keys)

    def last(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        level = flags["level"].to_numpy()
        if not table.num_rows:
            return pa.table([[]] * len(OUT), schema=OUT)
        table, data, offsets, cuts = resolve(table, flags.filter(pa.array(level == 1)))
        at = windows_of(data, offsets, cuts)
        distinct, place, count = _local(np.concatenate([h for _, h in at]))
        again = ((count > 1) | ex.told(flags.filter(pa.array(level == 2)), keys, 1)[0])[place]
        out: dict[str, list] = {name: [] for name in ("n_words", "n_removed", "kept", "spans", "longer")}
        done = 0
        for (a, b, known, _), (starts, _) in zip(cuts, at, strict=True):
            piece = Piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
            s = piece.segments
            repeated = np.zeros(len(piece.starts), dtype=bool)
            repeated[_ranges(s.first[known], s.end[known])] = True
            repeated[starts[again[done : done + len(starts)]]] = True
            done += len(starts)
            begin, end = _runs(repeated)
            gone = tb.covered(len(piece.starts), begin, end + window - 1)
            _collect(piece, gone, out)
            longer: list[list[bytes]] = [[] for _ in range(b - a)]
            for x, y, d in zip(begin, end, np.searchsorted(piece.limits, begin, side="right") - 1, strict=True):
                if y - x > window:
                    longer[d].append(piece.hashes[x : y + window - 1].tobytes())
            out["longer"] += longer
        return pa.table([table["id"].combine_chunks(), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["spans"], OUT.field("spans").type), table["row"].combine_chunks(), pa.array(out["longer"], pa.list_(pa.binary()))], schema=OUT)

    one = ex.judge(blocks.groupBy("block").applyInArrow(first, ex.SENT), keys, ex.segment_rule(LOW, by_order=False))
    two = ex.judge(blocks.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(second, ex.SENT), keys, ex.elsewhere)
    both = one.withColumn("level", F.lit(1)).unionByName(two.withColumn("level", F.lit(2)))
    done = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(last, "id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>, row long, longer array<binary>")
    return done.withColumnRenamed("id", id_col)


OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("row", pa.int64()), ("longer", pa.list_(pa.binary()))])


def _collect(piece: Piece, gone: np.ndarray, out: dict[str, list]) -> None:
    """Adds each text's results: kept words joined by single spaces."""
    limits = piece.limits
    keep = ~gone
    starts, ends = piece.starts[keep], piece.ends[keep]
    kept_before = np.concatenate(([0], np.cumsum(keep)))[limits]
    # Each kept word is taken with one byte behind it, which becomes its space.
    padded = np.append(piece.data, np.uint8(32))
    body, at = tb.gather(padded, starts, ends + 1)
    body[at[1:] - 1] = 32
    body = body.tobytes()
    for i in range(len(limits) - 1):
        a, b, f, g = limits[i], limits[i + 1], kept_before[i], kept_before[i + 1]
        out["n_words"].append(int(b - a))
        out["n_removed"].append(int((b - a) - (g - f)))
        out["kept"].append(body[at[f] : at[g] - 1].decode() if g > f else "")
        if g - f == b - a:
            out["spans"].append([])
            continue
        own = gone[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        out["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])

