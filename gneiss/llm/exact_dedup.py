"""Exact dedup by a Golomb-coded fingerprint exchange.

Blocks of fingerprints send them, sorted and as Golomb codes, to the owners of hash ranges and get back a bitmap of
those that another block has too. Only texts whose fingerprint is so suspected, by that or within its block, are looked
at again, and grouped by their very bytes. The suspected fingerprints are a written table, so that Spark knows its size:
where that is under its limit for broadcasts, texts are picked out where they are read and only suspects are shuffled;
beyond it, texts are joined with the fingerprints by a shuffle, which splits a fingerprint that a large share has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import exchange as ex
from gneiss.llm.work import fresh, written

U = np.uint64


def suspects(rows: DataFrame) -> DataFrame:
    """Distinct prints of rows (id, print), of exchange.BITS bits, that occur in more than one row."""
    spark = rows.sparkSession
    n = ex.width_of(spark)
    keys = ex.block_keys(n)
    blocks = rows.select(ex.by_hash(spark, "id", "print").alias("block"), "print").repartition(n, "block")

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        return ex.send(key[0].as_py(), np.unique(table["print"].to_numpy().astype(U)), n, keys)

    def select(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(["print"])
        own, count = np.unique(table["print"].to_numpy().astype(U), return_counts=True)
        return pa.table([own[(count > 1) | ex.told(flags, keys, 1)[0]].view(np.int64)], names=["print"])

    answers = ex.judge(blocks.groupBy("block").applyInArrow(encode, ex.SENT), keys, ex.elsewhere)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(select, "print long").distinct()


def _print(text: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - ex.BITS)


def _sha(text: Column | str) -> Column:
    return F.unhex(F.sha2(text, 256))


def copied(rows: DataFrame) -> DataFrame:
    """(sha, last, size) of each text that more than one of rows (id, text) has: SHA-256, largest id and number of rows."""
    found = written(suspects(rows.select("id", _print("text").alias("print"))), "suspects")
    checked = rows.withColumn("print", _print("text")).join(found, "print", "left_semi")
    groups = checked.groupBy("text").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(groups.select(_sha("text").alias("sha"), "last", "size"), "copied")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, null being empty. Of equal texts the row with the largest id stays; keep_id is
    its id and group_size counts rows. Rows equal in id and text are one in this: each is marked kept. A null id is the
    smallest; a group of null ids only has a null keep_id and is kept. Other columns of docs are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = rows.select("id", _sha("text").alias("sha")).join(copied(rows), "sha", "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("last"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with its columns, less all but one row of each group of equal texts; of rows equal in id and text one stays, whichever. Rows whose text occurs once pass where they are."""
    sha, last, number = fresh(docs, "sha", "last", "number")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    groups = copied(rows)
    # Texts whose largest id several rows have.
    again = rows.select("id", _sha("text").alias("sha")).join(groups, "sha").where(F.col("id").eqNullSafe(F.col("last")))
    again = written(again.groupBy("sha").agg(F.count(F.lit(1)).alias("number")).where("number > 1").select("sha"), "again")
    groups = groups.join(again.withColumn("number", F.lit(2)), "sha", "left").select(F.col("sha").alias(sha), F.col("last").alias(last), F.coalesce("number", F.lit(1)).alias(number))
    marked = docs.withColumn(sha, _sha(text)).join(groups, sha, "left")
    largest = F.col(id_col).cast("long").eqNullSafe(F.col(last))
    kept = marked.where(F.col(number).isNull() | (largest & (F.col(number) == 1)))
    if not again.isEmpty():
        kept = kept.unionByName(marked.where(largest & (F.col(number) > 1)).dropDuplicates([sha]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
