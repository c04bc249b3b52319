"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import codecs, kernels
from gneiss.operators import streams
from gneiss.plans import archive, constraints
from gneiss.sources import layout
from gneiss.sources.names import is_safe

AVERAGE = 1 << 14


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Sample streams: each user's values in cents."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("i"), F.round(F.col("value") * 100).cast("long").alias("sample"))


EVENTS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(round(value * 100) AS BIGINT) AS sample FROM events)"
DELTAS = "d AS (SELECT *, coalesce(sample - lag(sample) OVER (PARTITION BY user_id ORDER BY i), 0) AS d FROM e)"


def scan_inventory(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


def exact_objects(spark, sf):
    return _t(spark, sf, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_id")).select("first_id", "refs", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def name_checks(spark, sf):
    return _t(spark, sf, "pages").select("page_id", is_safe(F.col("url")).alias("safe"), is_safe(F.regexp_replace("url", "^[a-z]+://", "")).alias("safe_path"))


def deinterleave(spark, sf):
    flat = _t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return flat.groupBy("vec_id", F.pmod("pos", F.lit(4)).cast("int").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("x").cast("double") * 1024).cast("long") * (F.floor(F.col("pos") / 4) + 1)).cast("long").alias("weighted"))


def raw_spans_gaps(spark, sf):
    return streams.gaps(_t(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long")), "l_orderkey", "l_linenumber")


def pcm_delta(spark, sf):
    return streams.deltas(_events(spark, sf), ["user_id"], "i", "sample")


def pcm_shift_sign(spark, sf):
    return streams.shift_and_sign(pcm_delta(spark, sf), ["user_id"], "i", "sample")


def pcm_restore(spark, sf):
    d = pcm_delta(spark, sf)
    anchor = F.first("sample").over(Window.partitionBy("user_id").orderBy("i"))
    return d.withColumn("anchor", anchor).withColumn("restored", F.col("anchor") + streams.running(d, ["user_id"], "i", "d", "sum")).select("user_id", "i", "restored")


def affine_invariance(spark, sf):
    """Whether scaled, inverted and moved copies of a stream have its residuals."""
    base = pcm_delta(spark, sf)
    copy = streams.deltas(_events(spark, sf).withColumn("sample", 12345 - F.col("sample") * 8), ["user_id"], "i", "sample")
    one, two = (streams.shift_and_sign(x, ["user_id"], "i", "sample").select("user_id", F.col("shift").alias(f"shift{k}"), F.col("sign").alias(f"sign{k}")) for k, x in enumerate((base, copy)))
    q = lambda k, d: F.col(f"sign{k}") * F.call_function("shiftright", F.col(d), F.col(f"shift{k}"))
    rows = base.join(copy.select("user_id", "i", F.col("d").alias("e")), ["user_id", "i"]).join(one, "user_id").join(two, "user_id")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(q(0, "d") == q(1, "e"), 1).otherwise(0)).alias("equal"))


def _bytes(spark, sf):
    return _events(spark, sf).select("user_id", "i", F.pmod("sample", F.lit(256)).alias("b"))


def _xored(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("i")
    return rows.withColumn("p", F.coalesce(F.col("b").bitwiseXOR(F.lag("b").over(w)), F.lit(0)))


def dsd_xor(spark, sf):
    return _xored(_bytes(spark, sf))


def dsd_restore(spark, sf):
    x = _xored(_bytes(spark, sf))
    anchor = F.first("b").over(Window.partitionBy("user_id").orderBy("i"))
    return x.withColumn("anchor", anchor).withColumn("restored", F.col("anchor").bitwiseXOR(streams.running(x, ["user_id"], "i", "p", "xor"))).select("user_id", "i", "restored")


def dsd_complement_invariance(spark, sf):
    one, two = _xored(_bytes(spark, sf)), _xored(_bytes(spark, sf).withColumn("b", F.col("b").bitwiseXOR(F.lit(255))))
    return one.join(two.select("user_id", "i", F.col("p").alias("q")), ["user_id", "i"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("p") == F.col("q"), 1).otherwise(0)).alias("equal"))


def fixed_frame_chunks(spark, sf):
    return streams.fixed_frames(_events(spark, sf), ["user_id"], "i", "sample", 16).select("user_id", "chunk", "n", F.sha2("payload", 256).alias("sha256"))


def _prices(spark, sf):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return _t(spark, sf, "lineitem").select("l_suppkey", (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("l_quantity").cast("long").alias("sample"))


def dedup_reuse(spark, sf):
    """Chunks of two samples of each supplier's quantities, shared by their residuals: objects and how often they are used."""
    chunks = streams.fixed_frames(_prices(spark, sf), ["l_suppkey"], "i", "sample", 2)
    return chunks.groupBy("payload").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("l_suppkey").alias("streams")).select(F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("size"), "refs", "streams", (F.col("refs") - 1).alias("reused"))


def _blobs(spark, sf) -> DataFrame:
    """One byte stream for each hundred documents of a source."""
    d = _t(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 2000).cast("long").alias("part"), "doc_id", "text")
    rows = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    return d.groupBy("source", "part").agg(F.encode(F.array_join(F.transform(rows, lambda r: r["text"]), ""), "UTF-8").alias("content"))


def cdc_chunks(spark, sf):
    """Content-defined chunks of the documents of a source."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, part, content in zip(b["source"], b["part"], b["content"], strict=True):
                data = bytes(content)
                ends = kernels.content_cuts(data, "raw", AVERAGE)
                rows = [(source, part, n, a, e - a, data[a:e]) for n, (a, e) in enumerate(zip([0, *ends], ends, strict=False))]
                yield pd.DataFrame(rows, columns=["source", "part", "ordinal", "offset", "size", "payload"])

    cut = _blobs(spark, sf).mapInPandas(kernel, "source string, part long, ordinal long, offset long, size long, payload binary")
    return cut.select("source", "part", "ordinal", "offset", "size", F.sha2("payload", 256).alias("sha256"))


def gear_candidates(spark, sf):
    """Places in each document where the gear hash would let a chunk end."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [kernels.candidates(np.frombuffer(t.encode(), np.uint8), 1024) if t else np.empty(0, np.int64) for t in b["text"]]
            yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), [len(f) for f in found]), "place": np.concatenate([np.empty(0, np.int64), *found])})

    return _t(spark, sf, "documents").select("doc_id", "text").mapInPandas(kernel, "doc_id long, place long")


def restore_roundtrip(spark, sf):
    """Documents cut in pieces of 1000 characters, put together again."""
    d = _t(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 1000).cast("int"))).alias("ordinal"))
    pieces = d.select("doc_id", "ordinal", F.substring("text", F.col("ordinal") * 1000 + 1, F.lit(1000)).alias("payload"))
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "payload")))
    return pieces.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["payload"]), ""), 256).alias("sha256"), F.count(F.lit(1)).alias("pieces"))


def semi_objects(spark, sf):
    return _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def anti_objects(spark, sf):
    """Parts that no large line has."""
    lines = _t(spark, sf, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return constraints.unreferenced(_t(spark, sf, "part"), lines, "p_partkey").select("p_partkey", "p_brand")


def orphans(spark, sf):
    """Documents without a label, by source."""
    return constraints.unreferenced(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _uses(spark, sf) -> DataFrame:
    """Orders as files, return flags as kinds, suppliers as streams, parts as objects."""
    kind = F.when(F.col("l_returnflag") == "A", "semantic").when(F.col("l_returnflag") == "R", "native").otherwise("raw")
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), kind.alias("kind"), F.col("l_suppkey").alias("stream"), F.col("l_partkey").alias("object_id"), F.col("l_linestatus").alias("params"))


def _objects(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("object_id"), F.encode("p_name", "UTF-8").alias("data"))


def recipe_cost(spark, sf):
    """Cost of each kind of each order, less the parts that supplier 1 has already."""
    chosen = _t(spark, sf, "lineitem").where("l_suppkey = 1").select(F.col("l_partkey").alias("object_id")).distinct()
    return archive.recipe_costs(_uses(spark, sf), _objects(spark, sf), chosen)


def select_fixed(spark, sf):
    """The kind that each policy chooses for each order: its own, else raw."""
    uses, objects = _uses(spark, sf), _objects(spark, sf)
    one = lambda p: archive.select_recipes(uses, objects, p).withColumn("policy", F.lit(p))
    return one("raw").unionByName(one("native")).unionByName(one("semantic"))


def select_hybrid(spark, sf):
    """The kind that the hybrid policy takes for the first orders, file by file."""
    return archive.select_recipes(_uses(spark, sf).where("file_id <= 300"), _objects(spark, sf), "hybrid")


def raw_spans(spark, sf):
    """Bytes that no channel owns, of files of one-bit samples in blocks whose sizes are the documents'."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n in zip(b["doc_id"], b["n"], strict=True):
                c = 1 + int(i) % 6
                info = dict(zip(layout.KEYS, ("dsf", "dsd", c, 2822400, 8 * int(n), 1, 1, 92, -(-int(n) // layout.BLOCK) * layout.BLOCK * c, layout.BLOCK, "lsb"), strict=True))
                rows += [(i, a, k) for a, k in layout.raw_spans(info, 92 + info["data_size"] + int(i) % 3)]
            yield pd.DataFrame(rows, columns=["doc_id", "first", "length"])

    sizes = _t(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n")).where("n > 0")
    return sizes.mapInPandas(kernel, "doc_id long, first long, length long")


def codec_best(spark, sf):
    """Smallest codec of each distinct document."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [codecs.encode(t.encode()) for t in b["text"]]
            yield pd.DataFrame({"sha256": b["sha256"], "codec": [c for c, _ in out], "bytes": [len(d) for _, d in out]})

    texts = _t(spark, sf, "documents").select("text").distinct().withColumn("sha256", F.sha2("text", 256))
    return texts.mapInPandas(kernel, "sha256 string, codec string, bytes long")


def ordinals_contiguous(spark, sf):
    """Orders whose lines are not numbered from 1 without a gap or repeat, and how many are not."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("ordinal"))
    return constraints.misnumbered(lines, "l_orderkey", "ordinal").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("wrong"))


def one_recipe_each(spark, sf):
    orders = _t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return constraints.not_one_each(_t(spark, sf, "customer"), orders, "c_custkey")


def multiset_difference(spark, sf):
    """Lines that should be there, numbered 1 to 4 in each order, against those that are: n above 0 are missing, below 0 too many."""
    due = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("l_linenumber"))
    return constraints.multiset_difference(due, _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


def inspect_summary(spark, sf):
    d = _t(spark, sf, "documents").withColumn("kind", F.when(F.octet_length("text") == F.length("text"), "ascii").otherwise("wide"))
    return d.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("text").alias("objects"), F.sum(F.octet_length("text")).cast("long").alias("bytes")).withColumn("references_reused", F.col("pieces") - F.col("objects"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (scan_inventory, exact_objects, name_checks, deinterleave, raw_spans_gaps, pcm_delta, pcm_shift_sign, pcm_restore, affine_invariance, dsd_xor, dsd_restore, dsd_complement_invariance, fixed_frame_chunks, dedup_reuse, cdc_chunks, gear_candidates, restore_roundtrip, semi_objects, anti_objects, orphans, recipe_cost, select_fixed, select_hybrid, raw_spans, codec_best, ordinals_contiguous, one_recipe_each, multiset_difference, inspect_summary)}
FLAGSHIP = "dedup_reuse"

_LOW = "(CASE WHEN every = 0 THEN 0 ELSE bit_count((every & -every) - 1) END)"
_SWAP = "((({0}) & 255) * 16777216 + ((({0}) >> 8) & 255) * 65536 + ((({0}) >> 16) & 255) * 256 + ((({0}) >> 24) & 255))"


def _signs(name: str, source: str) -> str:
    """CTEs `name` (user_id, anchor, shift, sign, frames) of deltas in `source`."""
    return f"""{name}_f AS (SELECT user_id, arg_min(sample, i) AS anchor, bit_or(abs(d)) AS every, count(*) AS frames FROM {source} GROUP BY user_id),
    {name}_g AS (SELECT *, CAST({_LOW} AS INT) AS shift FROM {name}_f),
    {name}_u AS (SELECT s.user_id, i, (d >> shift) & 4294967295 AS u FROM {source} s JOIN {name}_g USING (user_id)),
    {name}_1 AS (SELECT user_id, arg_min(u, i) AS u FROM {name}_u WHERE u NOT IN (0, 2147483648) GROUP BY user_id),
    {name} AS (SELECT user_id, anchor, shift, CASE WHEN u IS NULL OR {_SWAP.format("u")} < {_SWAP.format("(-u) & 4294967295")} THEN 1 ELSE -1 END AS sign, frames FROM {name}_g LEFT JOIN {name}_1 USING (user_id))"""


_XOR = "x AS (SELECT *, coalesce(xor(b, lag(b) OVER (PARTITION BY user_id ORDER BY i)), 0) AS p FROM b)"
_BYTES = f"{EVENTS}, b AS (SELECT user_id, i, ((sample % 256) + 256) % 256 AS b FROM e)"
_PART = r"^(con|prn|aux|nul|(com|lpt)[1-9¹²³]) *(\..*)?$"


def _safe(x: str) -> str:
    return f"""(length({x}) > 0 AND length({x}) <= 220 AND NOT contains({x}, chr(92)) AND len(string_split({x}, '/')) <= 16 AND
    len(list_filter(string_split({x}, '/'), lambda p: p IN ('', '.', '..') OR regexp_matches(p, '[ .]$') OR regexp_matches(p, '[<>:"|?*\\x00-\\x1F]') OR regexp_matches(lower(p), '{_PART}'))) = 0)"""


def _chunks(cte: str, group: str, frames: int) -> str:
    return f"""c AS (SELECT *, i // {frames} AS chunk FROM {cte}),
    cd AS (SELECT *, coalesce(sample - lag(sample) OVER (PARTITION BY {group}, chunk ORDER BY i), 0) AS d FROM c),
    ch AS (SELECT {group}, chunk, count(*) AS n, string_agg(CAST(d AS VARCHAR), ',' ORDER BY i) AS payload FROM cd GROUP BY {group}, chunk)"""


_USES = "u AS (SELECT l_orderkey AS file_id, CASE l_returnflag WHEN 'A' THEN 'semantic' WHEN 'R' THEN 'native' ELSE 'raw' END AS kind, l_suppkey AS stream, l_partkey AS object_id, l_linestatus AS params FROM lineitem)"
ORACLES: dict[str, str] = {
    "raw_spans": """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, 1 + doc_id % 6 AS c, doc_id % 3 AS tail FROM documents WHERE text <> ''),
    e AS (SELECT *, 92 + (n + 4095) // 4096 * 4096 * c AS stop, n % 4096 AS used FROM d),
    p AS (SELECT doc_id, stop - (c - unnest(range(c))) * 4096 + used AS first, 4096 - used AS length, stop, tail FROM e WHERE used > 0),
    a AS (SELECT doc_id, 0 AS first, 92 AS length FROM e UNION ALL SELECT doc_id, first, length + CASE WHEN first + length = stop THEN tail ELSE 0 END FROM p UNION ALL SELECT doc_id, stop, tail FROM e WHERE used = 0 AND tail > 0)
    SELECT doc_id, CAST(first AS BIGINT) AS first, CAST(length AS BIGINT) AS length FROM a""",
    "cdc_chunks": f"""WITH RECURSIVE g AS (SELECT t, CAST('0x' || substr(sha256('gear:' || t), 13, 4) AS BIGINT) & 16383 AS g FROM range(256) r(t)),
    d AS (SELECT source, doc_id // 2000 AS part, regexp_extract_all(hex(encode(string_agg(text, '' ORDER BY doc_id))), '..') AS parts FROM documents GROUP BY ALL),
    y AS (SELECT source, part, unnest(parts) AS x, generate_subscripts(parts, 1) AS place FROM d),
    v AS (SELECT source, part, place, g FROM y JOIN g ON t = CAST('0x' || x AS BIGINT)),
    w AS (SELECT source, part, place, {" + ".join(f"coalesce(lag(g, {j}) OVER z, 0) * {1 << j}" for j in range(14))} AS s FROM v WINDOW z AS (PARTITION BY source, part ORDER BY place)),
    k AS (SELECT source, part, list(place ORDER BY place) AS ends FROM w WHERE s & 16383 = 0 GROUP BY ALL),
    n AS (SELECT source, part, len(parts) AS size, coalesce(ends, []) AS ends FROM d LEFT JOIN k USING (source, part)),
    c AS (SELECT source, part, size, ends, -1::BIGINT AS ordinal, 0::BIGINT AS first, 0::BIGINT AS stop FROM n UNION ALL
    SELECT source, part, size, ends, ordinal + 1, stop, least(size, stop + 65536, coalesce(list_min(list_filter(ends, lambda e: e >= stop + 8192)), size)) FROM c WHERE stop < size)
    SELECT source, part, ordinal, first AS offset, stop - first AS size, sha256(unhex(array_to_string(parts[first + 1:stop], ''))) AS sha256 FROM c JOIN d USING (source, part) WHERE ordinal >= 0""",
    "scan_inventory": "SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents",
    "exact_objects": "SELECT min(doc_id) AS first_id, count(*) AS refs, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents GROUP BY text",
    "name_checks": f"SELECT page_id, {_safe('url')} AS safe, {_safe('path')} AS safe_path FROM (SELECT *, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)",
    "deinterleave": "WITH f AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT vec_id, CAST(pos % 4 AS INT) AS channel, count(*) AS n, CAST(sum(CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) * (pos // 4 + 1)) AS BIGINT) AS weighted FROM f GROUP BY ALL",
    "raw_spans_gaps": """WITH d AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM d),
    g AS (SELECT l_orderkey, min(n) AS first, max(n) AS last FROM r GROUP BY l_orderkey, run)
    SELECT l_orderkey, first, last, first - coalesce(lag(last) OVER (PARTITION BY l_orderkey ORDER BY first), 0) - 1 AS missing FROM g""",
    "pcm_delta": f"WITH {EVENTS}, {DELTAS} SELECT user_id, i, sample, d FROM d",
    "pcm_shift_sign": f"WITH {EVENTS}, {DELTAS}, {_signs('s', 'd')} SELECT * FROM s",
    "pcm_restore": f"WITH {EVENTS} SELECT user_id, i, sample AS restored FROM e",
    "affine_invariance": "SELECT user_id, count(*) AS n, count(*) AS equal FROM events GROUP BY user_id",
    "dsd_xor": f"WITH {_BYTES}, {_XOR} SELECT user_id, i, b, p FROM x",
    "dsd_restore": f"WITH {_BYTES} SELECT user_id, i, b AS restored FROM b",
    "dsd_complement_invariance": "SELECT user_id, count(*) AS n, count(*) AS equal FROM events GROUP BY user_id",
    "fixed_frame_chunks": f"WITH {EVENTS}, {_chunks('e', 'user_id', 16)} SELECT user_id, chunk, n, sha256(payload) AS sha256 FROM ch",
    "dedup_reuse": f"WITH p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, CAST(l_quantity AS BIGINT) AS sample FROM lineitem), {_chunks('p', 'l_suppkey', 2)} SELECT sha256(payload) AS sha256, length(payload) AS size, count(*) AS refs, count(DISTINCT l_suppkey) AS streams, count(*) - 1 AS reused FROM ch GROUP BY payload",
    "gear_candidates": f"""WITH g AS (SELECT t, CAST('0x' || substr(sha256('gear:' || t), 13, 4) AS BIGINT) & 1023 AS g FROM range(256) r(t)),
    h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS parts FROM documents),
    y AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS place FROM h),
    v AS (SELECT doc_id, place, g FROM y JOIN g ON t = CAST('0x' || x AS BIGINT)),
    w AS (SELECT doc_id, place, {" + ".join(f"coalesce(lag(g, {j}) OVER z, 0) * {1 << j}" for j in range(10))} AS s FROM v WINDOW z AS (PARTITION BY doc_id ORDER BY place))
    SELECT doc_id, place FROM w WHERE s & 1023 = 0""",
    "restore_roundtrip": "SELECT doc_id, sha256(text) AS sha256, length(text) // 1000 + 1 AS pieces FROM documents",
    "semi_objects": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderstatus",
    "anti_objects": "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 48)",
    "orphans": "SELECT source, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE labels.doc_id IS NULL GROUP BY source",
    "recipe_cost": f"""WITH {_USES},
    stored AS (SELECT file_id, kind, sum(octet_length(encode(p_name)) + 112) AS stored FROM (SELECT DISTINCT file_id, kind, object_id FROM u WHERE object_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)) JOIN part ON object_id = p_partkey GROUP BY ALL),
    r AS (SELECT file_id, kind, sum(112 + octet_length(encode(params))) AS rows, count(DISTINCT stream) * 96 AS streams FROM u GROUP BY ALL)
    SELECT file_id, kind, CAST(coalesce(stored, 0) + rows + streams AS BIGINT) AS cost FROM r LEFT JOIN stored USING (file_id, kind)""",
    "select_fixed": f"WITH {_USES}, p AS (SELECT unnest(['raw', 'native', 'semantic']) AS policy) SELECT DISTINCT file_id, policy, CASE WHEN bool_or(kind = policy) OVER (PARTITION BY file_id, policy) THEN policy ELSE 'raw' END AS kind FROM u, p WHERE kind IN (policy, 'raw')",
    "ordinals_contiguous": "WITH t AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS due FROM lineitem) SELECT l_orderkey, count(*) AS wrong FROM t WHERE l_linenumber <> due GROUP BY l_orderkey",
    "one_recipe_each": "SELECT c_custkey, count(o_custkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_custkey) <> 1",
    "multiset_difference": "WITH e AS (SELECT o_orderkey AS l_orderkey, CAST(unnest(range(1, 5)) AS INT) AS l_linenumber FROM orders), x AS (SELECT *, 1 AS n FROM e UNION ALL SELECT l_orderkey, l_linenumber, -1 FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY ALL HAVING sum(n) <> 0",
    "inspect_summary": "SELECT source, CASE WHEN octet_length(encode(text)) = length(text) THEN 'ascii' ELSE 'wide' END AS kind, count(*) AS pieces, count(DISTINCT text) AS objects, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) - count(DISTINCT text) AS references_reused FROM documents GROUP BY ALL",
}
