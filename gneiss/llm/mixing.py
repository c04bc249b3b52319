"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's target is its share by weight of the words to take, at most `most` times what it has, with the excess
shared again. The blocks of the mix go to the sources by highest quotients target / (2k - 1); each source's blocks go
to its shards in the same way; and within a shard, whose documents stand in seeded order, seeded systematic selection
takes that many blocks, whole copies first. All of it is DataFrame expressions. The words of each text are counted once.
Windows run over shards of bounded size, over the shards of a source and over the sources, never over the documents of
a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.work import written

#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def quotas(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds `quota`, the seats of each party of a group by highest quotients votes / (2k - 1), ties by name.

    A group's n parties get seats within n / 2 of any divisor's quotients in all, so that votes / all * (seats - n / 2),
    rounded, is below each quota and votes / all * (seats + n / 2) above it. The quotients between, about 2n in a group,
    are ranked for the seats that are left. Parties without votes get none.
    """
    total = Window.partitionBy(*group) if group else Window.partitionBy()
    some = F.col(votes) > 0
    first = parties.withColumn("__all", F.sum(F.when(some, F.col(votes))).over(total)).withColumn("__n", F.count(F.when(some, 1)).over(total))
    share = F.col(votes) / F.col("__all")
    rounded = lambda slack: F.floor(share * F.greatest(F.col(seats) + slack, F.lit(0)) + 0.5)
    first = first.withColumn("__least", F.when(some, rounded(-F.col("__n") / 2 - 2)).otherwise(0).cast("long"))
    first = first.withColumn("__most", F.when(some, rounded(F.col("__n") / 2 + 2)).otherwise(0).cast("long"))
    first = first.withColumn("__miss", F.col(seats) - F.sum("__least").over(total))
    each = first.withColumn("__k", F.explode(F.sequence("__least", "__most")))
    each = each.withColumn("__quotient", F.when(F.col("__k") > F.col("__least"), F.col(votes) / (2 * F.col("__k") - 1)))
    each = each.withColumn("__rank", F.row_number().over(total.orderBy(F.desc_nulls_last("__quotient"), party, "__k")))
    won = F.count(F.when(F.col("__quotient").isNotNull() & (F.col("__rank") <= F.col("__miss")), 1))
    return each.groupBy(*parties.columns, "__least").agg(won.alias("__won")).withColumn("quota", F.col("__least") + F.col("__won")).drop("__least", "__won")


def targets(sizes: DataFrame, budget: float, weights: list[float], most: float) -> DataFrame:
    """Of sources (source, source_size), nulls last by code point: number from 1 on, weight (weights repeat) and target. Water level: sources stop at most * source_size, in the order in which a rising level meets their limits."""
    names = Window.orderBy(F.col("source").isNull(), "source")
    out = sizes.withColumn("number", F.row_number().over(names))
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1))
    out = out.withColumn("limit", F.col("source_size") * float(most)).withColumn("meets", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    met = Window.orderBy("meets", "number")
    out = out.withColumn("words", budget * F.sum("source_size").over(everything))
    # The level if this source and those before it stop at their limits; the first that holds is below the next limit.
    out = out.withColumn("stopped", F.sum("limit").over(met)).withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(met))
    out = out.withColumn("after", F.lead("meets").over(met))
    out = out.withColumn("place", F.row_number().over(met)).withColumn("level", F.when(F.col("after").isNotNull(), (F.col("words") - F.col("stopped")) / F.col("rest")))
    first = F.min(F.when(F.col("level") <= F.col("after"), F.struct("place", "level"))).over(everything)["level"]
    none = F.when(F.col("words") / F.sum("weight").over(everything) <= F.min("meets").over(everything), F.col("words") / F.sum("weight").over(everything))
    out = out.withColumn("level", F.coalesce(none, first, F.max("meets").over(everything)))
    return out.select("source", "number", "source_size", "weight", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def _drawn(seed: int, digits: int, *parts: Column) -> Column:
    """A number of so many hex digits, from the seed and the parts."""
    text = F.concat(F.lit(str(seed)), *[x for p in parts for x in (F.lit("\n"), F.coalesce(p.cast("string"), F.lit("")))])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, budget: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: float = 2.0, block: int = 64, fineness: int = 16, shard_words: int = 1 << 21, seed: int = 17) -> DataFrame:
    """One row per row of docs: id, size (words), source_size, target (the source's), taken (words, repeats counted).

    budget: words of the mix for each word of docs. block: words in a block; where the smallest target above 0 is under
    `fineness` blocks, all blocks are smaller, of one word at least. shard_words: words of a source for each shard,
    about. Sources by code point take weights in turn, null last. Null texts have no words. A source without words has
    the target 0. Rows with equal ids are told apart by their texts; equal rows get words together, each in its turn,
    and may get different numbers. Nothing depends on the order or partitions of docs.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"), _drawn(seed, 15, F.col(id_col), F.col(text_col)).alias("draw"))
    rows = written(rows, "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), budget, list(weights), most)
    every = Window.partitionBy()
    least = F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / fineness)
    goal = goal.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.coalesce(least, F.lit(1)))).cast("long"))
    goal = goal.withColumn("seats", F.floor(F.sum("target").over(every) / F.col("block") + 0.5).cast("long"))
    goal = quotas(goal, [], "number", "target", "seats").withColumnRenamed("quota", "blocks")
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    goal = written(goal.select(F.col("source").alias("name"), "number", "source_size", "target", "block", "blocks", "shards"), "targets")
    named = rows.join(goal, F.col("source").eqNullSafe(F.col("name"))).withColumn("shard", F.pmod("draw", "shards"))
    totals = named.groupBy("number", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("seats"))
    totals = quotas(totals, ["number"], "shard", "shard_size", "seats").select("number", "shard", "shard_size", "quota")
    dealt = named.join(totals, ["number", "shard"])
    order = Window.partitionBy("number", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    return dealt.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(most, seed).alias("taken"))


def _taken(most: float, seed: int) -> Column:
    """Words that the selected blocks take of [start, end) of a shard: its quota's words, or `most` times its own if these are fewer, as whole passes over it and a rest. The rest's blocks are spread evenly over the shard's whole blocks from a seeded offset, and the last is cut to what is left; the short block at the end is only taken where all others are."""
    size, block = F.col("shard_size"), F.col("block")
    words = F.least(F.col("quota") * block, F.floor(size * float(most)))
    passes = F.when(size > 0, F.floor(words / size)).otherwise(0)
    rest = words - passes * size
    whole, chosen = F.floor(size / block), F.floor(rest / block)
    left = rest - chosen * block
    cut = (chosen < whole) & (left > 0)
    n = chosen + cut.cast("long")
    turn = _drawn(seed + 2, 5, F.col("number"), F.col("shard")) / float(1 << 20)

    def before(x: Column) -> Column:
        """Words of the rest that stand before place x."""
        j = F.least(F.floor(x / block), whole)
        count = lambda k: F.when(whole > 0, F.floor(k * n / whole + turn)).otherwise(0)
        here = count(j)
        full = here * block - F.when(cut & (here == n), block - left).otherwise(0)
        inside = F.when((j < whole) & (count(j + 1) > here), F.least(x - j * block, F.when(cut & (here == n - 1), left).otherwise(block))).otherwise(0)
        tail = F.when((j == whole) & (chosen == whole), F.least(x - whole * block, left)).otherwise(0)
        return full + inside + tail

    return F.when(size > 0, passes * (F.col("end") - F.col("start")) + before(F.col("end")) - before(F.col("start"))).otherwise(0).cast("long")
