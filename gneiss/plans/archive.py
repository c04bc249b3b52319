"""Archives: files cut into shared objects, kept as six Parquet tables, and restored byte for byte.

pack() reads files into one row each, cuts every file in three ways at once (raw, native, semantic), keeps each distinct
payload once, and then chooses per policy with joins and aggregates. Distinct payloads are encoded once. All tables are
DataFrames; only the greedy hybrid policy and the final choice run on the driver, over at most 10000 files.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import codecs, kernels, strictjson
from gneiss.sources import layout
from gneiss.sources.names import collect_sources, safe_name, validate_names

KINDS, POLICIES = ("raw", "native", "semantic"), ("raw", "native", "semantic", "hybrid")
#: Fixed values of the cost model, in bytes: an object, a piece, a stream.
OBJECT, PIECE, STREAM = 112, 112, 96
FILES = f"file_id long, path string, size long, sha256 string, info {layout.LAYOUT}"
PIECES = "file_id long, kind string, stream int, role string, channel int, offset long, ordinal int, transform string, params string, size long, payload binary"
TABLES = ("meta", "files", "recipes", "streams", "pieces", "objects")


class ArchiveError(ValueError):
    """An archive, or what should become one, that breaks a rule."""


def read_sources(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """(file_id, path, content) of named files; ids from 1 in the names' order."""
    names = spark.createDataFrame([(i, n, p, Path(p).stat().st_size) for i, (n, p) in enumerate(sources, 1)], "file_id long, path string, place string, length long")
    files = spark.read.format("binaryFile").load([f"file://{p}" for _, p in sources])
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("place"), "content")
    # Spark's reader leaves empty files out.
    content = F.when(F.col("content").isNotNull() | (F.col("length") == 0), F.coalesce("content", F.lit(b""))).otherwise(F.raise_error(F.concat(F.lit("not read: "), "path")).cast("binary"))
    return names.join(files, "place", "left").select("file_id", "path", content.alias("content"))


def describe(files: DataFrame) -> DataFrame:
    """FILES of (file_id, path, content)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_id": b["file_id"], "info": [layout.probe(bytes(c)) for c in b["content"]]})

    probed = files.select("file_id", "content").mapInPandas(kernel, f"file_id long, info {layout.LAYOUT}")
    facts = files.select("file_id", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    return facts.join(probed, "file_id")


def _streams(content: bytes, kind: str) -> Iterator[tuple[str, int, int, bytes, int, str]]:
    """(role, channel, offset, bytes, width, sample kind) of each stream of a file."""
    info = None if kind == "raw" else layout.probe(content)
    for offset, length in layout.raw_spans(info, len(content)) or [(0, 0)] * (not content):
        yield "raw", -1, offset, content[offset : offset + length], 1, "raw"
    for channel in range(info["channels"] if info else 0):
        yield "channel", channel, 0, layout.read_channel(content, info, channel), info["width"], info["kind"]


def cut_file(content: bytes, kind: str, average: int) -> Iterator[tuple]:
    """stream, role, channel, offset, ordinal, transform, params, size and payload of each piece; a stream without bytes has one row without payload."""
    for number, (role, channel, offset, data, width, sampled) in enumerate(_streams(content, kind)):
        semantic = kind == "semantic" and role == "channel"
        ends = kernels.frame_cuts(len(data), width, average) if sampled == "pcm" else kernels.content_cuts(data, "dsd" if semantic else "raw", average)
        if not ends:
            yield number, role, channel, offset, -1, "raw", "{}", 0, None
            continue
        for ordinal, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            part, meta, transform = data[a:b], {}, "raw"
            if semantic:
                transform = sampled
                part, meta = kernels.canonical_pcm(part, width) if sampled == "pcm" else kernels.canonical_dsd(part)
                if restored(part, transform, meta, width) != data[a:b]:
                    raise ArchiveError("a transform does not restore its piece")
            yield number, role, channel, offset, ordinal, transform, strictjson.dump(meta), b - a, part


def restored(payload: bytes, transform: str, meta: dict, width: int) -> bytes:
    if transform == "pcm":
        return kernels.restore_pcm(payload, meta, width)
    if transform == "dsd":
        return kernels.restore_dsd(payload, meta)
    if meta or transform != "raw":
        raise ArchiveError("unknown transform")
    return payload


def cut(files: DataFrame, average: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """PIECES of (file_id, content) under each kind, of opaque files under raw alone."""
    kernels.check_average(average)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            for i, content in zip(b["file_id"], b["content"], strict=True):
                # Opaque files have no channels to be cut by.
                for kind in kinds if layout.probe(bytes(content)) else ("raw",):
                    rows = [(i, kind, *row) for row in cut_file(bytes(content), kind, average)]
                    yield pd.DataFrame(rows, columns=names)

    return files.select("file_id", "content").mapInPandas(kernel, PIECES)


def distinct_objects(pieces: DataFrame) -> DataFrame:
    """first, payload, size and sha256 of each distinct payload. Rows are grouped by the payload itself, so equal hashes never merge different bytes; first is the place of the first use."""
    first = F.min(F.struct("file_id", "kind", "stream", "ordinal")).alias("first")
    objects = pieces.where("payload is not null").groupBy("payload").agg(first)
    return objects.select("first", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha256"))


def numbered(objects: DataFrame) -> DataFrame:
    """Objects with object_id in place of first, in its order. Only the places go through the one window, of which an archive has 2 million at most."""
    ids = objects.select("first", F.row_number().over(Window.orderBy("first")).cast("long").alias("object_id"))
    return objects.join(ids, "first").drop("first")


def encoded(objects: DataFrame) -> DataFrame:
    """Objects with codec, encoded_sha256 and data in place of the payload."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [codecs.encode(bytes(p)) for p in b["payload"]]
            yield pd.DataFrame({"object_id": b["object_id"], "sha256": b["sha256"], "size": b["size"], "codec": [c for c, _ in pairs], "width": 1, "data": [d for _, d in pairs]})

    out = objects.mapInPandas(kernel, "object_id long, sha256 string, size long, codec string, width int, data binary")
    return out.withColumn("encoded_sha256", F.sha2("data", 256))


def recipe_costs(uses: DataFrame, objects: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """cost of each (file_id, kind): its distinct objects not yet chosen, its pieces and its streams."""
    own = uses.where("object_id is not null").select("file_id", "kind", "object_id").distinct()
    if chosen is not None:
        own = own.join(chosen, "object_id", "left_anti")
    stored = own.join(objects.select("object_id", F.octet_length("data").alias("bytes")), "object_id").groupBy("file_id", "kind").agg(F.sum(F.col("bytes") + OBJECT).alias("stored"))
    rows = uses.groupBy("file_id", "kind").agg(F.sum(F.when(F.col("object_id").isNotNull(), PIECE + F.octet_length("params")).otherwise(0)).alias("rows"), (F.countDistinct("stream") * STREAM).alias("streams"))
    return rows.join(stored, ["file_id", "kind"], "left").select("file_id", "kind", (F.coalesce("stored", F.lit(0)) + F.col("rows") + F.col("streams")).cast("long").alias("cost"))


def select_recipes(uses: DataFrame, objects: DataFrame, policy: str) -> DataFrame:
    """(file_id, kind) for each file: of the policy's kind, else raw; hybrid takes, file by file, the kind that costs least beside what is chosen already."""
    spark = uses.sparkSession
    kinds = uses.select("file_id", "kind").distinct()
    if policy != "hybrid":
        own = kinds.where(F.col("kind").isin(policy, "raw"))
        rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.when(F.col("kind") == policy, 0).otherwise(1)))
        return own.withColumn("rank", rank).where("rank = 1").drop("rank")
    if policy not in POLICIES:
        raise ArchiveError(f"unknown policy {policy}")
    fixed = {(r["file_id"], r["kind"]): r["cost"] for r in recipe_costs(uses, objects, objects.select("object_id")).collect()}
    needed: dict[tuple, dict[int, int]] = {k: {} for k in fixed}
    own = uses.where("object_id is not null").select("file_id", "kind", "object_id").distinct().join(objects.select("object_id", (F.octet_length("data") + OBJECT).alias("bytes")), "object_id")
    for r in own.toLocalIterator():
        needed[r["file_id"], r["kind"]][r["object_id"]] = r["bytes"]
    have: set[int] = set()
    out = []
    for file in sorted({f for f, _ in fixed}):
        best = min((fixed[file, k] + sum(b for o, b in needed[file, k].items() if o not in have), i, k) for i, k in enumerate(KINDS) if (file, k) in fixed)
        have |= needed[file, best[2]].keys()
        out.append((file, best[2]))
    return spark.createDataFrame(out, "file_id long, kind string")


def materialise(folder: str, files: DataFrame, uses: DataFrame, objects: DataFrame, chosen: DataFrame, policy: str, average: int) -> int:
    """Writes the six tables of one policy, and returns their size in bytes."""
    spark = files.sparkSession
    own = uses.join(chosen, ["file_id", "kind"], "left_semi")
    recipes = chosen.select(F.col("file_id").alias("recipe_id"), "file_id", "kind")
    stream = (F.col("file_id") * 32 + F.col("stream")).alias("stream_id")
    streams = own.groupBy(stream, F.col("file_id").alias("recipe_id"), "role", "channel", "offset").agg(F.sum("size").cast("long").alias("size"))
    pieces = own.where("object_id is not null").select(stream, "ordinal", "object_id", "transform", "params", "size")
    kept = objects.join(pieces.select("object_id").distinct(), "object_id", "left_semi").select("object_id", F.substring("sha256", 1, 16).alias("bucket"), "sha256", "size", "codec", "width", "encoded_sha256", "data")
    settings = strictjson.dump({"average": average, "strategy": policy})
    meta = spark.createDataFrame([("version", "1"), ("complete", "yes"), ("settings", settings)], "key string, value string")
    for name, table in zip(TABLES, (meta, files, recipes, streams, pieces, kept), strict=True):
        table.coalesce(8).write.parquet(f"file://{folder}/{name}")
    return archive_bytes(folder)


def archive_bytes(folder: str) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def publish(folder: Path, output: str) -> None:
    """Moves a complete folder to a name that nothing else has: the name is taken first, which fails if it exists, and what was taken is given back if the move fails."""
    try:
        os.mkdir(output)
    except FileExistsError as e:
        raise ArchiveError(f"{output} exists") from e
    try:
        os.rename(folder, output)
    except OSError:
        os.rmdir(output)
        raise


def state(path: str) -> tuple[str, int, int, int]:
    """A file's path, size, time of change and inode."""
    s = Path(path).stat()
    return path, s.st_size, s.st_mtime_ns, s.st_ino


def pack(spark: SparkSession, sources: list[str], output: str, *, average: int = 65536, mode: str = "auto", allow_growth: bool = False, work_dir: str | None = None) -> dict:
    """Makes an archive of files and folders; the smallest of the policies if mode is auto. Nothing is kept that saves nothing, unless allow_growth. work_dir, by default the archive's folder, holds intermediate tables, and must be on its file system."""
    kernels.check_average(average)
    if mode not in (*POLICIES, "auto"):
        raise ArchiveError(f"unknown mode {mode}")
    if Path(output).exists():
        raise ArchiveError(f"{output} exists")
    listed = collect_sources(sources)
    before = [state(p) for _, p in listed]
    work = Path(tempfile.mkdtemp(prefix=".pack-", dir=work_dir or Path(output).resolve().parent))
    try:
        read = read_sources(spark, listed)
        describe(read).write.parquet(f"file://{work}/files")
        files = spark.read.schema(FILES).parquet(f"file://{work}/files")
        cut(read, average, ("raw",) if mode == "raw" else KINDS).write.parquet(f"file://{work}/cut")
        pieces = spark.read.schema(PIECES).parquet(f"file://{work}/cut")
        plain = distinct_objects(pieces)
        plain.write.parquet(f"file://{work}/plain")
        plain = spark.read.parquet(f"file://{work}/plain")
        plain = numbered(plain)
        if not plain.groupBy("sha256", "size").count().where("count > 1").isEmpty():
            raise ArchiveError("two objects have one SHA-256")
        encoded(plain).write.parquet(f"file://{work}/encoded")
        objects = spark.read.parquet(f"file://{work}/encoded")
        keyed = pieces.withColumn("sha256", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long")).drop("payload")
        keyed.join(objects.select("object_id", "sha256", F.col("size").alias("length")), ["sha256", "length"], "left").drop("sha256", "length").write.parquet(f"file://{work}/uses")
        uses = spark.read.parquet(f"file://{work}/uses")
        if before != [state(p) for _, p in listed]:
            raise ArchiveError("a source changed while it was read")
        sizes = {p: materialise(str(work / "policies" / p), files, uses, objects, select_recipes(uses, objects, p), p, average) for p in (POLICIES if mode == "auto" else (mode,))}
        best = min(sizes, key=lambda p: (sizes[p], POLICIES.index(p)))
        report = verify(spark, str(work / "policies" / best), dict(listed))
        saving = report["original_bytes"] - report["archive_bytes"]
        report |= inspect_archive(spark, str(work / "policies" / best)) | {"candidate_bytes": sizes, "net_saving_bytes": saving, "net_saving_percent": round(100 * saving / report["original_bytes"], 3) if report["original_bytes"] else None, "average": average}
        if saving <= 0 and not allow_growth:
            return report | {"content_verified": True, "status": "skipped_no_net_savings"}
        publish(work / "policies" / best, output)
        return report | {"content_verified": True, "status": "created", "archive": output}
    finally:
        shutil.rmtree(work, ignore_errors=True)


def open_archive(spark: SparkSession, archive: str) -> dict[str, DataFrame]:
    """The six tables, with exactly the columns that they must have."""
    from gneiss.plans import constraints

    if sorted(p.name for p in Path(archive).iterdir()) != sorted(TABLES):
        raise ArchiveError("the tables are not those of an archive")
    tables = {t: spark.read.parquet(f"file://{Path(archive).resolve()}/{t}") for t in TABLES}
    for name, table in tables.items():
        if [(f.name, f.dataType.simpleString().replace("bigint", "long")) for f in table.schema] != constraints.SCHEMAS[name]:
            raise ArchiveError(f"table {name} has other columns")
    constraints.check(tables)
    return tables


def restore(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, content) of all files. Each object is decoded once, and each file's pieces meet in one task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"object_id": b["object_id"], "payload": [codecs.decode(bytes(d), c, int(n)) for d, c, n in zip(b["data"], b["codec"], b["size"], strict=True)]})

    plain = tables["objects"].select("object_id", "data", "codec", "size").mapInPandas(decode, "object_id long, payload binary")
    good = plain.join(tables["objects"].select("object_id", "sha256"), "object_id").withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("an object has other bytes")).cast("binary")))
    facts = tables["files"].select("file_id", "path", F.col("size").alias("file_size"), F.to_json("info").alias("info"), F.col("sha256").alias("file_sha"))
    rows = tables["streams"].join(tables["recipes"].select("recipe_id", "file_id"), "recipe_id").join(tables["pieces"].withColumnRenamed("size", "piece_size"), "stream_id", "left").join(good.select("object_id", "payload"), "object_id", "left").join(facts, "file_id")

    def build(own: pd.DataFrame) -> pd.DataFrame:
        one = own.iloc[0]
        info = strictjson.load(one["info"]) if one["info"] else None
        out = np.zeros(int(one["file_size"]), np.uint8)
        for _, stream in own.sort_values(["stream_id", "ordinal"]).groupby("stream_id"):
            head = stream.iloc[0]
            parts = [restored(bytes(p), t, strictjson.load(m), info["width"] if info else 1) for p, t, m in zip(stream["payload"], stream["transform"], stream["params"], strict=True) if p is not None]
            data = b"".join(parts)
            if head["role"] == "raw":
                out[int(head["offset"]) : int(head["offset"]) + len(data)] = np.frombuffer(data, np.uint8)
            else:
                layout.write_channel(out, info, int(head["channel"]), data)
        return pd.DataFrame({"path": [one["path"]], "sha256": [one["file_sha"]], "content": [out.tobytes()]})

    files = rows.groupBy("file_id").applyInPandas(build, "path string, sha256 string, content binary")
    return files.select("path", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.lit("a file has other bytes")).cast("binary")).alias("content"))


def verify(spark: SparkSession, archive: str, compare_sources: dict[str, str] | None = None) -> dict:
    """Restores every file, and compares them with sources (name: path) if given."""
    tables = open_archive(spark, archive)
    back = restore(tables)
    if compare_sources is not None:
        names = {r["path"] for r in tables["files"].select("path").collect()}
        if missing := names - compare_sources.keys():
            raise ArchiveError(f"sources are missing: {sorted(missing)[:3]}")
        sources = read_sources(spark, [(n, compare_sources[n]) for n in sorted(names)]).select("path", F.col("content").alias("source"))
        if not back.join(sources, "path", "left").where(~F.col("content").eqNullSafe(F.col("source"))).isEmpty():
            raise ArchiveError("a source has other bytes than the archive")
    else:
        back.agg(F.sum(F.octet_length("content"))).collect()
    total = tables["files"].agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    settings = strictjson.load(tables["meta"].where("key = 'settings'").first()["value"])
    return {"verified": True, "files": total["n"], "original_bytes": total["size"], "archive_bytes": archive_bytes(archive), "strategy": settings["strategy"], "objects": tables["objects"].count(), "pieces": tables["pieces"].count()}


def inspect_archive(spark: SparkSession, archive: str) -> dict:
    """What the tables say; contents are not decoded."""
    t = open_archive(spark, archive)
    count = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
    objects, pieces = t["objects"].count(), t["pieces"].count()
    files = [{"path": r["path"], "size": r["size"], "sha256": r["sha256"], "format": r["info"]["container"] if r["info"] else "opaque"} for r in t["files"].orderBy("file_id").collect()]
    return {"format": "gneiss archive 1", "structural_checks_passed": True, "content_verified": False, "archive_bytes": archive_bytes(archive), "original_bytes": sum(f["size"] for f in files), "strategy": strictjson.load(t["meta"].where("key = 'settings'").first()["value"])["strategy"], "objects": objects, "pieces": pieces, "references_reused": pieces - objects, "codecs": count(t["objects"], "codec"), "selected_recipes": count(t["recipes"], "kind"), "files_list": files}


def unpack(spark: SparkSession, archive: str, output: str) -> dict:
    """Writes all files, from the executors, to a new folder, which appears only when it is complete; the folder's file system must be one that they share."""
    if Path(output).exists():
        raise ArchiveError(f"{output} exists")
    tables = open_archive(spark, archive)
    total = tables["files"].agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    parent = Path(output).resolve().parent
    if shutil.disk_usage(parent).free < (total["size"] or 0):
        raise ArchiveError("not enough space")
    stage = parent / f".unpack-{uuid.uuid4().hex}"
    stage.mkdir()
    try:

        def write(rows: Iterator[Row]) -> None:
            for r in rows:
                safe_name(r["path"])
                place = stage / r["path"]
                place.parent.mkdir(parents=True, exist_ok=True)
                part = place.with_name(f".{uuid.uuid4().hex}")
                part.write_bytes(r["content"])
                part.rename(place)  # a task that runs again replaces what it wrote before

        restore(tables).foreachPartition(write)
        publish(stage, output)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return {"verified": True, "restored_files": total["n"], "original_bytes": total["size"], "output": output}


__all__ = ["ArchiveError", "inspect_archive", "pack", "unpack", "validate_names", "verify"]
