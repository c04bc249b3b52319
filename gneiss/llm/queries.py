"""Registered queries of the subpackage: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.decontaminate import contamination
from gneiss.llm.exact_dedup import exact_groups
from gneiss.llm.kneser_ney import perplexity
from gneiss.llm.licenses import LOWER, PHRASES, TEMPLATES, UPPER, license_scan
from gneiss.llm.minhash import near_groups
from gneiss.llm.mixing import mix
from gneiss.llm.pii import pseudonymised
from gneiss.llm.substring_dedup import repeats
from gneiss.llm.suffix_dedup import earlier_bytes
from gneiss.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, longest = repeats(table(spark, sf_dir, "documents"), window=35)
    out = out.select("row", "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))
    return out.join(longest, "row", "left").withColumn("longest", F.coalesce("longest", F.lit(0)).cast("long")).drop("row")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), key="a key of the caller's")


def checksum(number: Column) -> Column:
    """CRC-32 of a number's decimal digits."""
    return F.crc32(number.cast("string").cast("binary"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = checksum(F.col("doc_id")) % 5 == 0
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = earlier_bytes(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(checksum(F.col("doc_id")) % 7 == 2, F.lit(False))
    return perplexity(table(spark, sf_dir, "documents"), usable=~held_out)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_source_mix": op10_source_mix,
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _values(rows: list[tuple]) -> str:
    """Rows of texts, numbers and lists of words for VALUES."""
    cell = lambda x: str(x) if isinstance(x, int) else f"[{', '.join(map(cell, x))}]" if isinstance(x, list) else f"'{x}'"
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


_PHRASES = _values([(len(p.split()), p, label) for p, label in PHRASES.items()])
_TEMPLATES = _values([(label, sorted(set(t.split())), math.ceil(0.8 * len(set(t.split())) - 1e-9), math.floor(len(t.split()) / 0.8 + 1e-9)) for t, label in TEMPLATES.items()])
#: Levels of doubling that the SQL has: windows of up to 35 * 2**11 words.
_MOST = 12
_LONGEST = max(len(p.split()) for p in PHRASES)


def _levels(most: int) -> str:
    """CTEs v1, v2, ... of (doc_id, i, win) of the windows of 35 words, 70 and so on that occur more than once, each from the one before."""
    steps = ["v0 AS (SELECT doc_id, i, win FROM p WHERE win IN (SELECT win FROM r2))"]
    for k in range(1, most):
        both = f"SELECT x.doc_id, x.i, md5(x.win || y.win) AS win FROM v{k - 1} x JOIN v{k - 1} y ON x.doc_id = y.doc_id AND y.i = x.i + {35 << k - 1}"
        steps.append(f"v{k} AS (SELECT doc_id, i, win FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n FROM ({both})) WHERE n > 1)")
    return ", ".join(steps)


def _windows(table: str) -> str:
    """CTEs b2 to b32 of (doc_id, i, b, and the hex digits of that many bytes from i on), each from the one before."""
    steps = []
    for n in (2, 4, 8, 16, 32):
        last = "b" if n == 2 else f"x{n // 2}"
        steps.append(f"b{n} AS (SELECT *, {last} || lead({last}, {n // 2}) OVER z AS x{n} FROM {table if n == 2 else f'b{n // 2}'} WINDOW z AS (PARTITION BY doc_id ORDER BY i))")
    return ", ".join(steps)


def _quotas(table: str, group: str, party: str, votes: str, seats: str) -> str:
    """Query of a table's rows with their seats (quota) by highest quotients."""
    over = f"PARTITION BY {group}" if group else ""
    return f"""SELECT * EXCLUDE (least_, most_, miss, n, share, k, quotient, place), CAST(any_value(least_) + count(*) FILTER (quotient IS NOT NULL AND place <= miss) AS BIGINT) AS quota FROM (
    SELECT *, row_number() OVER ({over} ORDER BY quotient DESC NULLS LAST, {party}, k) AS place FROM (
    SELECT *, CASE WHEN k > least_ THEN CAST({votes} AS DOUBLE) / (2 * k - 1) END AS quotient FROM (SELECT *, unnest(range(least_, most_ + 1)) AS k FROM (
    SELECT *, {seats} - sum(least_) OVER ({over}) AS miss FROM (
    SELECT *, CAST(CASE WHEN {votes} > 0 THEN floor(share * greatest({seats} - n / 2 - 2, 0) + 0.5) ELSE 0 END AS BIGINT) AS least_, CAST(CASE WHEN {votes} > 0 THEN floor(share * ({seats} + n / 2 + 2) + 0.5) ELSE 0 END AS BIGINT) AS most_ FROM (
    SELECT *, {votes} / CAST(sum({votes}) OVER ({over}) AS DOUBLE) AS share, count(*) FILTER ({votes} > 0) OVER ({over}) AS n FROM {table})))))) GROUP BY ALL"""


def _before(x: str) -> str:
    """Words of a shard's rest before place x."""
    j = f"least(floor({x} / block), whole)"
    count = lambda k: f"(CASE WHEN whole > 0 THEN floor(({k}) * picked / whole + turn) ELSE 0 END)"
    here = count(j)
    return f"""({here} * block - CASE WHEN cut AND {here} = picked THEN block - over_ ELSE 0 END
    + CASE WHEN {j} < whole AND {count(j + " + 1")} > {here} THEN least({x} - {j} * block, CASE WHEN cut AND {here} = picked - 1 THEN over_ ELSE block END) ELSE 0 END
    + CASE WHEN {j} = whole AND chosen = whole THEN least({x} - whole * block, over_) ELSE 0 END)"""


_DRAW = "CAST('0x' || substr(md5({}), 1, {}) AS BIGINT)"
ORACLES: dict[str, str] = {
    "op10_source_mix": f"""WITH r AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, {_DRAW.format("'17' || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')", 15)} AS draw FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS number FROM r GROUP BY source),
    w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(number - 1) % 3 + 1] AS weight FROM s),
    m AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS meets, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM w),
    o AS (SELECT *, (words - sum(lim) OVER y) / nullif(sum(weight) OVER () - sum(weight) OVER y, 0) AS level, lead(meets) OVER y AS after, row_number() OVER y AS place FROM m WINDOW y AS (ORDER BY meets, number)),
    l AS (SELECT coalesce(CASE WHEN any_value(words) / sum(weight) <= min(meets) THEN any_value(words) / sum(weight) END, arg_min(level, place) FILTER (level <= after), max(meets)) AS level FROM o),
    t AS (SELECT m.*, least(lim, weight * level) AS target FROM m, l),
    g AS (SELECT *, CAST(greatest(1, least(64, coalesce(floor(min(target) FILTER (target > 0) OVER () / 16), 1))) AS BIGINT) AS block FROM t),
    h AS (SELECT source, number, source_size, target, block, CAST(floor(sum(target) OVER () / block + 0.5) AS BIGINT) AS seats, CAST(greatest(1, ceil(source_size / 2097152)) AS BIGINT) AS shards FROM g),
    q AS ({_quotas("h", "", "number", "target", "seats")}),
    d AS (SELECT doc_id, size, draw, number, source_size, target, block, quota AS seats, draw % shards AS shard FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source),
    u AS (SELECT number, shard, any_value(seats) AS seats, CAST(sum(size) AS BIGINT) AS shard_size FROM d GROUP BY ALL),
    v AS ({_quotas("u", "number", "shard", "shard_size", "seats")}),
    x AS (SELECT d.*, shard_size, least(quota * block, CAST(floor(2.0 * shard_size) AS BIGINT)) AS words, {_DRAW.format("'19' || chr(10) || d.number || chr(10) || d.shard", 5)} / 1048576 AS turn FROM d JOIN v ON d.number = v.number AND d.shard = v.shard),
    p AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes, shard_size // block AS whole, CAST(sum(size) OVER (PARTITION BY number, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM x),
    a AS (SELECT *, (words - passes * shard_size) // block AS chosen, (words - passes * shard_size) % block AS over_, stop - size AS start FROM p),
    b AS (SELECT *, chosen < whole AND over_ > 0 AS cut, chosen + CAST(chosen < whole AND over_ > 0 AS BIGINT) AS picked FROM a)
    SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size > 0 THEN passes * size + {_before("stop")} - {_before("start")} ELSE 0 END AS BIGINT) AS taken FROM b""",
    "op1_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    p AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
    r2 AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1), r AS (SELECT doc_id, i FROM p WHERE win IN (SELECT win FROM r2)), {_levels(_MOST)},
    lo AS (SELECT doc_id, max(n) AS longest FROM ({" UNION ALL ".join(f"SELECT DISTINCT doc_id, {35 << k} AS n FROM v{k}" for k in range(_MOST))}) GROUP BY doc_id),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
    e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
    k AS (SELECT e.doc_id, e.j, word, c.j IS NOT NULL AS gone FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.j = c.j),
    s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM k),
    o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept, count(*) FILTER (starts) AS n_spans FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INT) AS n_spans, CAST(coalesce(longest, 0) AS BIGINT) AS longest FROM w LEFT JOIN o USING (doc_id) LEFT JOIN lo USING (doc_id)""",
    "op5_exact_dedup": """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_suffix_array_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
    y AS (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM d),
    {_windows("y")},
    w AS (SELECT doc_id, i, b, x32 || lead(x16, 32) OVER z || lead(x2, 48) OVER z AS win FROM b32 WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
    f AS (SELECT win, min(doc_id) AS first FROM w WHERE win IS NOT NULL GROUP BY win),
    g AS (SELECT doc_id, i, b, coalesce(first < doc_id, false) AS again FROM w LEFT JOIN f USING (win)),
    c AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) AS gone FROM g),
    s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
    o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(len(bs) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)""",
    "op7_license_scan": f"""WITH d AS (SELECT doc_id, {_LOWER} AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, {_ALNUM}) AS ws FROM d),
    e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
    r AS (SELECT doc_id, i, [word{"".join(f", lead(word, {k}) OVER z" for k in range(1, _LONGEST))}] AS run FROM e WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
    p AS (SELECT doc_id, i, label FROM r JOIN (VALUES {_PHRASES}) AS v(n, phrase, label) ON array_to_string(run[1:n], ' ') = phrase),
    t(label, ws, least, width) AS (VALUES {_TEMPLATES}),
    h AS (SELECT doc_id, i, word, label, ws, least, width FROM e JOIN (SELECT *, unnest(ws) AS word FROM t) USING (word)),
    m AS (SELECT x.doc_id, x.label, count(DISTINCT y.word) / len(x.ws) AS share FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.ws = y.ws AND y.i BETWEEN x.i AND x.i + x.width - 1 GROUP BY x.doc_id, x.label, x.ws, x.i, x.least HAVING count(DISTINCT y.word) >= x.least),
    b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
    x AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
    z AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score FROM w LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS own FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
    c AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT c.doc_id, b FROM c JOIN l ON reached = a),
    k AS (SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept, coalesce(min(n.doc_id) OVER (PARTITION BY own), doc_id) AS set_id FROM w JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
