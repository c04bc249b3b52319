"""MinHash near-dedup with b-bit signatures.

One pass over the texts makes each document's distinct word shingles, and of them a key of the whole set, band keys of
full minima, and a packed signature of the low bits of the minima. Documents with equal sets become one. Within a band
bucket, sets are first paired with the bucket's smallest only. The signatures' equal bits, corrected for chance
collisions, estimate the similarity and drop pairs that are far below the threshold; bitmaps of the sets bound it from
above and drop most others; what is left is confirmed on full sets. Then only buckets whose sets are not yet all
connected are looked at again: first for the likeliest pairs that would connect their components, as many as there are
components less one, and last for every pair between the components that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import textbytes as tb
from gneiss.llm.components import components, joined
from gneiss.llm.work import written

U = np.uint64
BANDS, ROWS = 32, 4
#: Low bits of each minimum that a signature retains.
KEPT = 4
#: Standard deviations of the estimate that a pair may fall below the threshold before it is dropped.
SLACK = 6.0
TILE = 1000
#: Pairs of one first member that are confirmed together, and bytes of their texts, about.
GROUP, GROUP_BYTES = 256, 4 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and where each begins. Fewer words than `width` are one shingle."""
    data = tb.lower_ascii(data)
    starts, ends, limits = tb.words(data, offsets)
    sums = tb.prefix(tb.word_hashes(data, starts, ends))
    n = np.diff(limits)
    count = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) + np.repeat(limits[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    hashes = tb.span(sums, at, np.minimum(at + width, limits[1:][doc]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.empty(0, bool)
    return hashes[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Minima, one row per nonempty text, under BANDS * ROWS hash functions."""
    rng = np.random.default_rng(20_240_229)
    factors = rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    turns = rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
    low, high = (hashes & U(0xFFFFFFFF)).astype(np.uint32), (hashes >> U(32)).astype(np.uint32)
    at = limits[:-1][np.diff(limits) > 0]
    out = np.empty((len(at), BANDS * ROWS), dtype=np.uint32)
    for i, (f, t) in enumerate(zip(factors, turns, strict=True)):
        out[:, i] = np.minimum.reduceat((low ^ t) * f + high, at) if len(at) else 0
    return out


def bitmaps(hashes: np.ndarray, limits: np.ndarray) -> list[bytes]:
    """Of each set, which of 2**k places its hashes fall on, with 4 to 8 places an element, 256 at least."""
    out = []
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        places = 1 << max(8, int(4 * (b - a) - 1).bit_length())
        bits = np.zeros(places, np.uint8)
        bits[hashes[a:b] & U(places - 1)] = 1
        out.append(np.packbits(bits).tobytes())
    return out


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps, the last axis, on fewer places."""
    return np.bitwise_or.reduce(bitmap.reshape(*bitmap.shape[:-1], -1, size), axis=-2)


def at_most(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Bound of the similarity from above: a place that one set alone has stands for an element of it that the other lacks."""
    most = np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))
    return most / (nx + ny - most)


SIGNED = "id long, n_bytes long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary, bitmap binary"


def sign(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) to SIGNED; empty sets have null bands."""

    def kernel(batches):
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            for a, b in tb.pieces(offsets):
                hashes, limits = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                size = np.diff(limits)
                full = size > 0
                minima = signatures(hashes, limits)
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(tb.mix(hashes ^ U(salt)), dtype=U))) for salt in (0x1F3D5B79, 0x2E4C6A88)]
                sets = [np.where(full, (s[limits[1:]] - s[limits[:-1]]), U(0)).view(np.int64) for s in sums]
                bands = np.empty((len(minima), BANDS), dtype=U)
                for k in range(BANDS):
                    h = tb.mix(np.full(len(minima), k + 1, dtype=U))
                    for r in range(ROWS):
                        h = tb.mix(h ^ minima[:, k * ROWS + r].astype(U))
                    bands[:, k] = h
                low = (tb.mix(minima.astype(U)) & U((1 << KEPT) - 1)).astype(np.uint8)
                packed = np.packbits(((low[:, :, None] >> np.arange(KEPT, dtype=np.uint8)) & 1).reshape(len(low), -1), axis=1) if len(low) else np.empty((0, BANDS * ROWS * KEPT // 8), np.uint8)
                at = np.concatenate(([0], np.cumsum(full)))
                lists = pa.ListArray.from_arrays(pa.array(at * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
                rows = [packed[i].tobytes() if f else None for i, f in zip(at[:-1], full, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], pa.array(np.diff(offsets[a : b + 1]), pa.int64()), pa.array(size, pa.int64()), pa.array(sets[0]), pa.array(sets[1]), lists, pa.array(rows, pa.binary()), pa.array(bitmaps(hashes, limits), pa.binary())], names=["id", "n_bytes", "n_shingles", "set_a", "set_b", "bands", "signature", "bitmap"])

    return docs.mapInArrow(kernel, SIGNED)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures: the share of minima whose kept bits all agree, less chance collisions."""
    differ = np.unpackbits(x ^ y, axis=-1).reshape(*np.broadcast_shapes(x.shape, y.shape)[:-1], BANDS * ROWS, KEPT).any(axis=-1)
    equal = 1 - differ.mean(axis=-1)
    chance = 2.0**-KEPT
    return (equal - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """Estimates below this are dropped."""
    chance = 2.0**-KEPT
    equal = threshold * (1 - chance) + chance
    return threshold - SLACK * float(np.sqrt(equal * (1 - equal) / (BANDS * ROWS))) / (1 - chance)


def _packed(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, BANDS * ROWS * KEPT // 8)


def likely(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that neither sizes, estimate nor bitmaps rule out."""
    own = signed.select("id", "n_shingles", "signature", "bitmap")
    sides = pairs.join(own.toDF("a", "na", "sa", "ba"), "a").join(own.toDF("b", "nb", "sb", "bb"), "b")
    sides = sides.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    least = floor_of(threshold)

    def kernel(batches):
        for batch in batches:
            n = batch.num_rows
            good = np.flatnonzero(agreement(_packed(batch.column("sa"), n), _packed(batch.column("sb"), n)) >= least) if n else np.empty(0, np.int64)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = []
            for i in good:
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint8) for c in ("ba", "bb"))
                size = min(len(x), len(y))
                if at_most(folded(x, size), folded(y, size), na[i], nb[i]) >= threshold - 1e-9:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return sides.mapInArrow(kernel, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs some of whose texts' full sets have 100 * intersection >= percent * union. The pairs of one first member are dealt out in groups of about GROUP or GROUP_BYTES, whichever is reached first, each with that member's texts; own has the texts' n_bytes."""
    share = F.greatest(F.lit(1 / GROUP), F.col("n_bytes") / GROUP_BYTES)
    parts = pairs.join(own.select(F.col("id").alias("b"), "n_bytes"), "b").groupBy("a").agg(F.ceil(F.sum(share)).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "part", "text")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "part", "text")

    def kernel(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        head = table["b"].is_null().to_numpy()
        data, offsets = tb.texts(table["text"].filter(pa.array(head)))
        hashes, limits = shingle_sets(data, offsets, width)
        own = [hashes[x:y] for x, y in zip(limits[:-1], limits[1:], strict=True)]
        rest = table.filter(pa.array(~head))
        data, offsets = tb.texts(rest["text"])
        good = np.zeros(rest.num_rows, dtype=bool)
        for a, b in tb.pieces(offsets):
            hashes, limits = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            size = np.diff(limits)
            for x in own:
                same = np.concatenate(([0], np.cumsum(x[np.minimum(np.searchsorted(x, hashes), len(x) - 1)] == hashes))) if len(x) else np.zeros(len(hashes) + 1, np.int64)
                both = same[limits[1:]] - same[limits[:-1]]
                good[a:b] |= 100 * both >= percent * (len(x) + size - both)
        return rest.select(["a", "b"]).filter(pa.array(good))

    return members.unionByName(heads).groupBy("a", "part").applyInArrow(kernel, "a long, b long")


def _forest(left: np.ndarray, right: np.ndarray, likeliest_first: np.ndarray) -> np.ndarray:
    """Of pairs of components in this order, those that connect what is not connected yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in likeliest_first:
        x, y = find(int(left[i])), find(int(right[i]))
        if x != y:
            root[x] = y
            out.append(i)
    return np.array(out, dtype=np.int64)


def between(members: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """Likely pairs of sets in one bucket but different components, or of them a forest over the components; members: key, id, component, n_shingles, signature, and the bucket's number of sets. Large buckets are compared tile by tile."""
    tiled = members.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = tiled.select("key", "id", "component", "n_shingles", "signature", "bitmap", "tile", other).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    least = floor_of(threshold)

    def kernel(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.num_rows
        ids, of, size = (table[c].to_numpy() for c in ("id", "component", "n_shingles"))
        packed = _packed(table["signature"], n)
        maps = [np.frombuffer(x, np.uint8) for x in table["bitmap"].to_pylist()]
        width = np.array([len(x) for x in maps])
        # Sets that can reach the threshold differ in width by one step at most.
        near = {w: np.flatnonzero((width >= w) & (width <= 2 * w)) for w in np.unique(width)}
        level = {w: np.stack([folded(maps[k], w) for k in at]) for w, at in near.items()}
        left, right, bound = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            rest = rest[(of[rest] != of[i]) & (np.minimum(size[rest], size[i]) >= threshold * np.maximum(size[rest], size[i]) - 1e-9)]
            if len(rest):
                rest = rest[agreement(packed[i], packed[rest]) >= least]
                for w in np.unique(np.minimum(width[rest], width[i])):
                    own = rest[np.minimum(width[rest], width[i]) == w]
                    row = np.searchsorted(near[w], np.append(i, own))
                    most = at_most(level[w][row[0]], level[w][row[1:]], size[i], size[own])
                    good = most >= threshold - 1e-9
                    left.append(np.full(good.sum(), i))
                    right.append(own[good])
                    bound.append(most[good])
        i, j = np.concatenate(left), np.concatenate(right)
        if forest:
            kept = _forest(of[i], of[j], np.argsort(-np.concatenate(bound), kind="stable"))
            i, j = i[kept], j[kept]
        x, y = ids[i], ids[j]
        return pa.table([np.minimum(x, y), np.maximum(x, y)], names=["a", "b"])

    return dealt.groupBy("key", "low", "high").applyInArrow(kernel, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, set_id.

    A-Z is lower-cased; words are runs of other than ASCII spaces; a document's set has its distinct runs of `shingle`
    words, or all its words if they are fewer. Documents are linked if 100 * intersection >= percent * union.
    component_id is the smallest id that links reach, set_id the smallest id with the same set; kept marks the row with
    the component's own id. Null or empty texts and such without words have the empty set and are linked with nothing.
    Rows with a null id are linked with nothing and kept; an id that several rows have is linked with all that any of
    its texts is. Links that banding misses have a chance of under 1e-7 each at 80 percent, and of 2e-4 at 70, the least allowed.
    """
    if not 70 <= percent <= 100:
        raise ValueError("the bands are for similarities of 70 to 100 percent")
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = written(sign(rows, shingle), "signatures")
    full = signed.where("n_shingles > 0 and id is not null")
    # Documents with equal sets: the smallest id stands for all.
    sets = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("set_id"))
    owned = written(full.select("id", "set_a", "set_b", "n_shingles").join(sets, ["set_a", "set_b", "n_shingles"]).select("id", "n_shingles", "set_id"), "sets")
    own = full.join(sets, ["set_a", "set_b", "n_shingles"]).where("id = set_id").dropDuplicates(["id", "set_a", "set_b", "n_shingles"])
    own = written(own.select("id", "n_bytes", "n_shingles", "bands", "signature", "bitmap"), "own")
    # A key is of one band, as each band's keys are hashed apart. Only buckets of several sets are kept.
    buckets = own.select("id", F.explode("bands").alias("key"))
    firsts = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(buckets.join(firsts, "key"), "buckets")
    star = shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    texts = rows.where("id is not null")
    tried = written(likely(star, own, threshold).distinct(), "tried")
    links = written(confirmed(tried, texts, own, shingle, percent).distinct(), "confirmed")
    # An id that several rows share links its rows' sets.
    same = owned.where("id <> set_id").select(F.col("set_id").alias("a"), F.col("id").alias("b"))
    links = links.unionByName(same.join(own.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b").distinct())
    found = written(components(links), "components")
    for forest in (True, False):
        # Buckets whose sets are in more than one component.
        places = shared.where("size > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), "size")
        mixed = places.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        # Only members of such buckets are joined with their signatures.
        members = written(places.join(mixed, "key", "left_semi"), "members")
        members = members.join(own.select("id", "n_shingles", "signature", "bitmap"), "id")
        more = written(between(members, threshold, forest).join(tried, ["a", "b"], "left_anti"), "more")
        tried = tried.unionByName(more)
        found = joined(found, confirmed(more, texts, own, shingle, percent))
    every = signed.select("id", "n_shingles", "set_a", "set_b").join(sets, ["set_a", "set_b", "n_shingles"], "left")
    every = every.withColumn("set_id", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("set_id")).otherwise(F.col("id")))
    every = every.join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
    component = F.coalesce("component", "set_id")
    return every.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "set_id")
