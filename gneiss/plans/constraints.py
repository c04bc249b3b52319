"""Rules of an archive's tables, each a DataFrame of the rows that break it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import kernels, strictjson
from gneiss.sources import layout
from gneiss.sources.names import validate_names

_INFO = layout.LAYOUT
SCHEMAS = {
    "meta": [("key", "string"), ("value", "string")],
    "files": [("file_id", "long"), ("path", "string"), ("size", "long"), ("sha256", "string"), ("info", _INFO)],
    "recipes": [("recipe_id", "long"), ("file_id", "long"), ("kind", "string")],
    "streams": [("stream_id", "long"), ("recipe_id", "long"), ("role", "string"), ("channel", "int"), ("offset", "long"), ("size", "long")],
    "pieces": [("stream_id", "long"), ("ordinal", "int"), ("object_id", "long"), ("transform", "string"), ("params", "string"), ("size", "long")],
    "objects": [("object_id", "long"), ("bucket", "string"), ("sha256", "string"), ("size", "long"), ("codec", "string"), ("width", "int"), ("encoded_sha256", "string"), ("data", "binary")],
}
#: The most rows and bytes that an archive may have, the most streams of a file, and of all files the most bytes of metadata, with what a file adds beside its texts.
MOST_FILES, MOST_OBJECTS, MOST_PIECES, MOST_BYTES = 10_000, 2_000_000, 8_000_000, 64 << 40
MOST_STREAMS, MOST_METADATA, METADATA_OF_FILE = 32, 32 << 20, 128


def due_streams(files: DataFrame, recipes: DataFrame) -> DataFrame:
    """(recipe_id, role, channel, offset, size) of the streams that each recipe must have, by its kind and its file's layout; one row of role '' for a recipe that cannot be."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for recipe, kind, size, text in zip(b["recipe_id"], b["kind"], b["size"], b["info"], strict=True):
                info = strictjson.load(text) if text else None
                if kind == "raw":
                    rows.append((recipe, "raw", -1, 0, size))
                elif info is None or not layout.valid(info, int(size)):
                    rows.append((recipe, "", -1, 0, size))
                else:
                    rows += [(recipe, "raw", -1, a, n) for a, n in layout.raw_spans(info, int(size))]
                    rows += [(recipe, "channel", c, 0, layout.channel_size(info)) for c in range(info["channels"])]
            yield pd.DataFrame(rows, columns=["recipe_id", "role", "channel", "offset", "size"])

    both = recipes.join(files.select("file_id", "size", F.to_json("info").alias("info")), "file_id").select("recipe_id", "kind", "size", "info")
    return both.mapInPandas(kernel, "recipe_id long, role string, channel int, offset long, size long")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, and by how many (n above 0: the left one)."""
    names = left.columns
    both = left.withColumn("n", F.lit(1)).unionByName(right.withColumn("n", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")


def misnumbered(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Rows whose ordinal is not their place in their group, counted from 0 in the ordinals' order."""
    due = F.row_number().over(Window.partitionBy(group).orderBy(ordinal)) - 1
    return rows.withColumn("due", due).where(F.col(ordinal) != F.col("due"))


def unreferenced(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """Rows whose key no row of the other table has."""
    return rows.join(by, key, "left_anti")


def not_one_each(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Keys that the other table has not exactly once, and how often it has them."""
    return rows.select(key).join(of.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def bad_layouts(files: DataFrame) -> DataFrame:
    """file_id of files whose layout does not agree with itself or their size."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [not t or (n >= 0 and layout.valid(strictjson.load(t), int(n))) for t, n in zip(b["info"], b["size"], strict=True)]
            yield b.loc[[not g for g in good], ["file_id"]]

    return files.select("file_id", "size", F.to_json("info").alias("info")).mapInPandas(kernel, "file_id long")


def bad_params(pieces: DataFrame) -> DataFrame:
    """stream_id of pieces whose parameters are not those of their transform, or not in strict JSON; pieces: stream_id, transform, params, size, width."""

    def good(transform: str, text: str, size: int, width: int) -> bool:
        try:
            meta = strictjson.load(text)
        except ValueError:
            return False
        if not isinstance(meta, dict) or any(type(v) is not int for v in meta.values()):
            return False
        if transform == "pcm":
            return set(meta) == {"anchor", "shift", "sign", "frames"} and meta["sign"] in (1, -1) and 0 <= meta["shift"] < 32 and 0 <= meta["anchor"] < 1 << 8 * width and meta["frames"] * width == size
        return set(meta) == {"anchor"} and 0 <= meta["anchor"] < 256 if transform == "dsd" else transform == "raw" and not meta

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[not good(t, p, int(n), int(w)) for t, p, n, w in zip(b["transform"], b["params"], b["size"], b["width"], strict=True)], ["stream_id"]]

    return pieces.mapInPandas(kernel, "stream_id long")


def broken(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that break each rule; an archive is sound if all are empty."""
    files, recipes, streams, pieces, objects = (t[n] for n in ("files", "recipes", "streams", "pieces", "objects"))
    digest = "^[0-9a-f]{64}$"
    used = pieces.join(objects.select("object_id", F.col("size").alias("object_size")), "object_id")
    kinds = streams.join(recipes.select("recipe_id", "kind", "file_id"), "recipe_id")
    infos = files.select("file_id", F.col("info.kind").alias("sampled"), F.col("info.width").alias("width"))
    placed = used.join(kinds.select("stream_id", "role", "kind", "file_id"), "stream_id").join(infos, "file_id", "left")
    unit = F.when(F.col("transform") == "pcm", F.col("size") / F.col("width") * 4).otherwise(F.col("size"))
    sums = pieces.groupBy("stream_id").agg(F.sum("size").alias("sum"))
    semantic = (F.col("kind") == "semantic") & (F.col("role") == "channel")
    return {
        "C1 meta": t["meta"].groupBy("key").count().where("count <> 1 or key not in ('version', 'complete', 'settings')").select("key").unionByName(t["meta"].where("(key = 'complete' and value <> 'yes') or (key = 'version' and value <> '1') or length(value) > 8192").select("key")),
        "C4 file fields": files.where("file_id is null or file_id < 1 or path is null or length(path) not between 1 and 220 or size is null"),
        "C6 file sizes, digests and layouts": files.where((F.col("size") < 0) | ~F.col("sha256").rlike(digest)).select("file_id").unionByName(bad_layouts(files)),
        "C7 one recipe a file": not_one_each(files, recipes, "file_id").select("file_id").unionByName(recipes.where("kind not in ('raw', 'native', 'semantic')").select("file_id")).unionByName(unreferenced(recipes, files, "file_id").select("file_id")),
        "C8 streams": multiset_difference(streams.select("recipe_id", "role", "channel", "offset", "size"), due_streams(files, recipes)).select("recipe_id"),
        "C9 ordinals": misnumbered(pieces, "stream_id", "ordinal").select("stream_id"),
        "C10 sizes": pieces.where("size not between 1 and 4194304").select("stream_id").unionByName(streams.join(sums, "stream_id", "left").where("coalesce(sum, 0) <> size").select("stream_id")),
        "C11 transforms": placed.where((F.col("object_size") != unit) | ((F.col("transform") != "raw") & (~semantic | ~F.col("transform").eqNullSafe(F.col("sampled"))))).select("stream_id").unionByName(bad_params(placed.select("stream_id", "transform", "params", "size", F.coalesce("width", F.lit(1)).alias("width")))),
        "C12 objects there": unreferenced(pieces, objects, "object_id"),
        "C13 no orphans": unreferenced(pieces, streams, "stream_id").select("stream_id").unionByName(unreferenced(streams, recipes, "recipe_id").select("stream_id")).unionByName(unreferenced(objects, pieces, "object_id").select(F.col("object_id").alias("stream_id"))),
        "C14 object fields": objects.where(~F.col("codec").isin("raw", "zlib", "lzma") | ~F.col("width").eqNullSafe(F.lit(1)) | ~F.col("size").between(1, 8 << 20) | (F.octet_length("data") > (8 << 20) + (64 << 10)) | ~F.col("sha256").rlike(digest) | (F.sha2("data", 256) != F.col("encoded_sha256")) | (F.substring("sha256", 1, 16) != F.col("bucket"))).select("object_id"),
    }


def check(t: dict[str, DataFrame]) -> None:
    """Raises for the first rule that some row breaks."""
    from gneiss.plans.archive import ArchiveError

    for rule, rows in broken(t).items():
        if not rows.isEmpty():
            raise ArchiveError(f"the archive breaks {rule}")
    meta = {r["key"]: r["value"] for r in t["meta"].collect()}
    try:
        settings = strictjson.load(meta["settings"])
        kernels.check_average(settings["average"])
        good = set(settings) == {"average", "strategy"} and settings["strategy"] in ("raw", "native", "semantic", "hybrid")
    except (KeyError, TypeError, ValueError) as e:
        raise ArchiveError("the archive breaks C2 settings") from e
    facts = t["files"].agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.octet_length("path") + F.octet_length("sha256") + F.coalesce(F.octet_length(F.to_json("info")), F.lit(4)) + METADATA_OF_FILE).alias("metadata")).first()
    n, most = facts["n"], t["streams"].groupBy("recipe_id").count().agg(F.max("count")).first()[0] or 0
    if not good:
        raise ArchiveError("the archive breaks C2 settings")
    if not 1 <= n <= MOST_FILES or t["objects"].count() > MOST_OBJECTS or t["pieces"].count() > MOST_PIECES or most > MOST_STREAMS or t["recipes"].count() != n or facts["size"] > MOST_BYTES:
        raise ArchiveError("the archive breaks C3 or C13 limits")
    if facts["metadata"] > MOST_METADATA:
        raise ArchiveError("the archive breaks C4 metadata")
    try:
        validate_names([r["path"] for r in t["files"].select("path").collect()])
    except ValueError as e:
        raise ArchiveError("the archive breaks C5 names") from e
