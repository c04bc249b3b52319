"""Benchmark decontamination by q-gram lemma filtering.

Two texts within edit distance e of each other share at least |item| + 1 - q * (e + 1) of an item's character q-grams,
and all of them lie within e diagonals. q follows the item's length, so that this bound is above 0. The items of a
bounded slice of the benchmark are broadcast, and their q-grams are sorted arrays in each worker. A document's q-grams
that hit them are counted in overlapping bands of diagonals; a band that reaches the bound marks a region, and the region
is verified by banded alignment, which finds the least edit distance of the item to any part of the text on those
diagonals. Documents are only read, in whole and once per slice; nothing is shuffled but the hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import textbytes as tb
from gneiss.llm.work import written

U = np.uint64
#: Longest q-grams; and the length under which items must occur as they are.
LONGEST_GRAM, SHORT = 10, 20
#: Where the bound would be under so many q-grams, they are one character shorter.
FEW = 8
#: Pairs of equal q-grams that are held at once, about.
HELD = 1 << 21
SPREAD = U(0x9FB21C651E98DF25)
#: What stands for places outside a text in an alignment.
OUTSIDE = np.uint32(0xFFFFFFFF)

_values: list[np.ndarray] = []


def point_values(points: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit value for each code point."""
    if not _values:
        _values.append(tb.mix(np.arange(1, 0x110001, dtype=U) * U(0xD6E8FEB86659FD93)))
    return _values[0][points]


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts end to end, and where each text begins among them."""
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32), before[offsets]


def normalised(text: F.Column) -> F.Column:
    """What is compared: lower case, each run of other than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


class Grams:
    """Sorted hashes of the q-grams of the items of one q."""

    def __init__(self, items: list[np.ndarray], own: list[int], q: int):
        self.q = q
        found = [tb.rolling(tb.prefix(point_values(items[i])), q, mixed=False) for i in own]
        every = np.concatenate(found)
        order = np.argsort(every, kind="stable")
        self.of = np.repeat(own, [len(h) for h in found])[order]
        self.at = np.concatenate([np.arange(len(h)) for h in found])[order]
        self.hashes, self.count = np.unique(every, return_counts=True)
        self.first = np.cumsum(self.count) - self.count
        # A table of 32 places a q-gram or more rules most of a document's out.
        self.shift = U(64 - min(24, max(12, (32 * len(every)).bit_length())))
        self.sieve = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.sieve[self.place(self.hashes)] = True

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h * SPREAD) >> self.shift

    def hits(self, sums: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Item, place in it, place in the texts, and text of each shared q-gram that one text has whole, some of them at a time."""
        h = tb.rolling(sums, self.q, mixed=False)
        place = np.flatnonzero(self.sieve[self.place(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[place]), len(self.hashes) - 1)
        same = self.hashes[at] == h[place]
        place, at = place[same], at[same]
        doc = np.searchsorted(offsets, place, side="right") - 1
        whole = place + self.q <= offsets[doc + 1]
        place, at, doc = place[whole], at[whole], doc[whole]
        n = self.count[at]
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // HELD)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(n)), strict=True):
            own = n[a:b]
            entry = np.arange(own.sum()) + np.repeat(self.first[at[a:b]] - (np.cumsum(own) - own), own)
            yield self.of[entry], self.at[entry], np.repeat(place[a:b], own), np.repeat(doc[a:b], own)


class Slice:
    """Some items, the edits that each may have, and their q-grams."""

    def __init__(self, items: list[str], rate: float):
        self.items = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in items]
        self.size = np.array([len(x) for x in self.items], dtype=np.int64)
        self.budget = np.where(self.size < SHORT, 0, (self.size * rate).astype(np.int64))
        longest = self.size // (self.budget + 1)
        longest = np.where((longest > 4) & (self.size + 1 - longest * (self.budget + 1) < FEW), longest - 1, longest)
        q = np.where(self.size < SHORT, np.minimum(LONGEST_GRAM, self.size), np.clip(longest, 1, LONGEST_GRAM))
        self.need = np.maximum(1, self.size + 1 - q * (self.budget + 1))
        self.grams = [Grams(self.items, np.flatnonzero(q == k).tolist(), k) for k in sorted(set(q.tolist()))]

    def regions(self, points: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, least diagonal) of the bands of twice budget + 1 diagonals that hold as many places of the item's q-grams as its budget asks for."""
        sums, most, n = tb.prefix(point_values(points)), int(self.size.max()), len(self.items)
        found = []
        for grams in self.grams:

            def hits(grams: Grams = grams) -> Iterator[tuple[np.ndarray, ...]]:
                for item, inside, place, doc in grams.hits(sums, offsets):
                    yield item, inside, place, doc, doc * n + item

            # Pairs of text and item with too few hits on all diagonals together are out.
            pairs, counts, held = [], [], []
            for part in hits():
                pair, count = np.unique(part[-1], return_counts=True)
                pairs.append(pair)
                counts.append(count)
                held = [part] if len(pairs) == 1 else []
            if len(pairs) == 1:
                pair, count = pairs[0], counts[0]
            else:
                pair, of = np.unique(np.concatenate(pairs), return_inverse=True)
                count = np.bincount(of, weights=np.concatenate(counts), minlength=len(pair))
            pair = pair[count >= self.need[pair % n]]
            if not len(pair):
                continue
            # Rows of text, item, shift and band, and how many of the item's places hit. Where a part of the hits ends within a band, a place may count twice, which lets more bands through.
            rows, counts = [np.empty((4, 0), np.int64)], [np.empty(0, np.int64)]
            for part in held or hits():
                likely = pair[np.minimum(np.searchsorted(pair, part[-1]), len(pair) - 1)] == part[-1]
                item, inside, place, doc, _ = (x[likely] for x in part)
                width = self.budget[item] + 1
                # Bands start at every budget + 1, so that one holds any diagonals that are within the budget of each other.
                for shift in (0, 1):
                    band = (place - offsets[doc] - inside + most + shift * width) // (2 * width)
                    key = np.lexsort((inside, band, item, doc))
                    row, p = np.stack([doc, item, np.full(len(doc), shift), band])[:, key], inside[key]
                    first = np.append(True, (row[:, 1:] != row[:, :-1]).any(axis=0)) if len(key) else np.empty(0, bool)
                    start = np.flatnonzero(first)
                    new = first.copy()
                    new[1:] |= p[1:] != p[:-1]
                    if len(start):
                        rows.append(row[:, start])
                        counts.append(np.add.reduceat(new.astype(np.int64), start))
            row, of = np.unique(np.hstack(rows), axis=1, return_inverse=True)
            count = np.bincount(of.ravel(), weights=np.concatenate(counts), minlength=row.shape[1])
            doc, item, shift, band = row[:, count >= self.need[row[1]]]
            width = self.budget[item] + 1
            found += zip(doc.tolist(), item.tolist(), ((2 * band - shift) * width - most).tolist(), strict=True)
        return found

    def aligned(self, which: int, text: np.ndarray, low: int) -> tuple[int, int] | None:
        """Least edits within the budget, and where they end, of an item in a band of a text; short items must stand between spaces or ends."""
        item, budget = self.items[which], int(self.budget[which])
        if len(item) < SHORT:
            end = low + len(item)
            for at in (low, low + 1):
                end = at + len(item)
                if at >= 0 and end <= len(text) and (text[at:end] == item).all() and (at == 0 or text[at - 1] == 32) and (end == len(text) or text[end] == 32):
                    return 0, end
            return None
        edits, end = best_alignment(item, text, low - budget - 1, 4 * (budget + 1), budget)
        return (edits, end) if edits <= budget else None


def best_alignment(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int]:
    """Least edit distance of the whole item to any part of the text whose alignment stays on the diagonals [low, low + width], and where that part ends; budget + 1 if it is above the budget. One row of the band at a time; runs of insertions by a running minimum."""
    n = len(item)
    around = np.full(n + width, OUTSIDE, dtype=np.uint32)
    a, b = max(0, low), min(len(text), low + n + width)
    if a < b:
        around[a - low : b - low] = text[a:b]
    column = np.arange(width + 1)
    row = np.zeros(width + 1, dtype=np.int64)
    new = np.empty(width + 1, dtype=np.int64)
    for k, c in enumerate(item):
        np.add(row[:-1], around[k : k + width] != c, out=new[:-1])
        new[-1] = row[-1] + 1
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - column) + column
        if row.min() > budget:
            return budget + 1, 0
    j = int(row.argmin())
    return int(row[j]), max(0, min(len(text), n + low + j))


FOUND = "row long, item_id long, edits long, item_length long, start long, end long"
_slices: dict[str, Slice] = {}


def leaks(texts: DataFrame, ids: list[int], items: list[str], rate: float) -> DataFrame:
    """Hits of (row, text) in one slice, written; places are of the normalised text's characters. Each worker makes the slice's arrays of the broadcast items, which slices() bounds."""
    sent = texts.sparkSession.sparkContext.broadcast((ids, items))
    name = uuid.uuid4().hex

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_items = sent.value
        if name not in _slices:
            _slices.clear()
            _slices[name] = Slice(own_items, rate)
        part = _slices[name]
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            rows = []
            for a, b in tb.pieces(offsets):
                points, at = points_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for text, which, low in part.regions(points, at):
                    if hit := part.aligned(which, points[at[text] : at[text + 1]], low):
                        size = len(part.items[which])
                        rows.append((batch.column("row")[a + text].as_py(), own_ids[which], hit[0], size, max(0, hit[1] - size), hit[1]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], names=["row", "item_id", "edits", "item_length", "start", "end"])

    found = written(texts.mapInArrow(kernel, FOUND), "leaks")
    sent.unpersist()
    return found


def slices(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the benchmark in slices of about `limit` characters, one of which at a time the driver and a worker hold."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text")).where("length(text) > 0").distinct()
    ids, texts, held = [], [], 0
    for r in items.orderBy("id", "text").toLocalIterator():
        ids.append(r["id"])
        texts.append(r["text"])
        held += len(r["text"])
        if held >= limit:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, rate: float = 0.1, slice_chars: int = 4_000_000) -> DataFrame:
    """One row per distinct id of docs: id, contaminated, item_ids (sorted), hits (item_id, edits, item_length, start, end; edits least per item).

    A document is contaminated by an item if some part of it is within rate * |item| edits of the item, after lower
    case and with runs of other than letters and digits as one space. Items under 20 such characters must occur as they
    are, between spaces or the text's ends. Null and empty texts and items match nothing; rows with equal ids are taken
    together; a null id is an id like another. start is end - item_length, so about where the part begins. The rate must
    be under a fifth, where q-grams of a few characters still tell.
    """
    if not 0 <= rate < 0.2:
        raise ValueError("rate must be from 0 to under 0.2")
    texts = docs.select(F.col(id_col).cast("long").alias("row"), normalised(F.col(text_col)).alias("text"))
    found = None
    for ids, items in slices(benchmark, item_col, item_text_col, slice_chars):
        own = leaks(texts, ids, items, rate)
        found = own if found is None else found.unionByName(own)
    ids = texts.select("row").distinct()
    if found is None:
        found = docs.sparkSession.createDataFrame([], FOUND)
    best = found.groupBy("row", "item_id").agg(F.min(F.struct("edits", "item_length", "start", "end")).alias("hit"))
    hits = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item_id", "hit.edits", "hit.item_length", "hit.start", "hit.end"))).alias("hits")).withColumnRenamed("row", "found")
    out = ids.join(hits, ids["row"].eqNullSafe(hits["found"]), "left")
    return out.select(F.col("row").alias(id_col), F.col("hits").isNotNull().alias("contaminated"), F.coalesce(F.col("hits.item_id"), F.array().cast("array<long>")).alias("item_ids"), "hits")
