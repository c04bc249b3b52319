"""The archive's operators as window and aggregate expressions over rows, for streams kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = (1 << 32) - 1


def deltas(samples: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adds `d`: difference to the sample before, 0 for the first."""
    w = Window.partitionBy(*group).orderBy(order)
    return samples.withColumn("d", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0)))


def shift_and_sign(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """anchor, shift, sign and frames of each group of deltas(). The sign is that of the bytewise smaller payload, which the first residual other than 0 and 2**31 decides."""
    found = rows.groupBy(*group).agg(F.min_by(value, order).alias("anchor"), F.bit_or(F.abs("d")).alias("every"), F.count(F.lit(1)).alias("frames"))
    low = F.col("every").bitwiseAND(-F.col("every"))
    found = found.withColumn("shift", F.when(F.col("every") == 0, 0).otherwise(F.bit_count(low - 1)).cast("int"))
    residual = F.call_function("shiftright", F.col("d"), F.col("shift")).bitwiseAND(F.lit(MASK))
    own = rows.join(found.select(*group, "shift"), group).withColumn("u", residual).where(~F.col("u").isin(0, 1 << 31))
    first = own.groupBy(*group).agg(F.min_by("u", order).alias("u"))
    minus = (-F.col("u")).bitwiseAND(F.lit(MASK))
    sign = F.when(F.col("u").isNull() | (swapped(F.col("u")) < swapped(minus)), 1).otherwise(-1)
    return found.join(first, group, "left").select(*group, "anchor", "shift", sign.alias("sign"), "frames")


def swapped(u: Column) -> Column:
    """A 32-bit value with its bytes in reverse."""
    part = lambda i: F.call_function("shiftright", u, F.lit(8 * i)).bitwiseAND(F.lit(255))
    return part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * 256 + part(3)


def running(rows: DataFrame, group: list[str], order: str, value: str, how: str) -> Column:
    """Sum or XOR of all values up to a row."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.sum if how == "sum" else F.bit_xor)(value).over(w)


def gaps(rows: DataFrame, group: str, position: str) -> DataFrame:
    """Runs of consecutive positions of each group: first, last, and how many are missing before the run."""
    w = Window.partitionBy(group).orderBy(position)
    own = rows.select(group, position).distinct().withColumn("run", F.col(position) - F.row_number().over(w))
    runs = own.groupBy(group, "run").agg(F.min(position).alias("first"), F.max(position).alias("last"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy(group).orderBy("first")), F.lit(0))
    return runs.withColumn("missing", F.col("first") - before - 1).select(group, "first", "last", "missing")


def fixed_frames(samples: DataFrame, group: list[str], number: str, value: str, frames: int) -> DataFrame:
    """Chunks of so many samples: their residuals against the sample before in the chunk, in order, as one payload."""
    chunked = samples.withColumn("chunk", F.floor(F.col(number) / frames).cast("long"))
    own = deltas(chunked, [*group, "chunk"], number, value)
    rows = F.sort_array(F.collect_list(F.struct(number, "d")))
    return own.groupBy(*group, "chunk").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda r: r["d"].cast("string")), ",").alias("payload"))
