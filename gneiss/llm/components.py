"""Connected components of large graphs, each named by its smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.work import written

#: Up to how many links one task finds the components; more are taken round by round.
AT_ONCE = 1 << 20


def _components_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links, by hooking the larger label's node to the smaller and jumping to the labels' labels."""
    links = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not links:
        return
    node, at = np.unique(np.hstack(links).ravel(), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(node))
    while True:
        left, right = label[x], label[y]
        apart = left != right
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): of few in one task, which spares the driver a job or two a round; of many by alternating large-star and small-star steps, each of which links a node's neighbours to the smallest of them. The links of one node meet in a join by that node, which Spark splits where they are many; they are never held at once."""
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if links.count() <= AT_ONCE:
        return links.coalesce(1).mapInArrow(_components_at_once, "node long, component long")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        links = written(small, "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    return links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) when links (a, b) are added; only the components that these connect are looked at."""
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")).where("a <> b").distinct()
    between = written(between, "between")
    if between.isEmpty():
        return found
    merged = written(components(between), "merged")
    new = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(new.unionByName(merged.join(found, "node", "left_anti")), "components")
