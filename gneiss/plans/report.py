"""What packing gains, beside a ZIP of the same files: measured groups of files and a table of them."""

from __future__ import annotations

import time
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from gneiss.plans import archive
from gneiss.sources.names import collect_sources


def zip_reference(sources: list[str], output: str) -> int:
    """Bytes of a ZIP (deflate, level 9) of files and folders, with fixed times, whose content is read again and compared."""
    listed = collect_sources(sources)
    with zipfile.ZipFile(output, "x", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name, path in listed:
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as out, Path(path).open("rb") as f:
                while block := f.read(1 << 20):
                    out.write(block)
    with zipfile.ZipFile(output) as z:
        for name, path in listed:
            with z.open(name) as one, Path(path).open("rb") as two:
                while (block := one.read(1 << 20)) or block != two.read(1):
                    if block != two.read(len(block)):
                        raise archive.ArchiveError(f"the ZIP has other bytes: {name}")
    return Path(output).stat().st_size


def measure(spark: SparkSession, name: str, sources: list[str], folder: str, *, average: int = 16384) -> dict:
    """Packs, verifies and unpacks one group of files into a folder of its own, and compares what comes back."""
    place = Path(folder) / name
    place.mkdir(parents=True)
    began = time.perf_counter()
    report = archive.pack(spark, sources, str(place / "archive"), average=average, allow_growth=True)
    packed = time.perf_counter()
    archive.verify(spark, str(place / "archive"))
    verified = time.perf_counter()
    archive.unpack(spark, str(place / "archive"), str(place / "back"))
    done = time.perf_counter()
    for n, p in collect_sources(sources):
        if (place / "back" / n).read_bytes() != Path(p).read_bytes():
            raise archive.ArchiveError(f"not restored: {n}")
    size = zip_reference(sources, str(place / "reference.zip"))
    return {"group": name, "files": report["files"], "original_bytes": report["original_bytes"], "archive_bytes": report["archive_bytes"], "strategy": report["strategy"], "zip_bytes": size, "kept": report["net_saving_bytes"] > 0, "pack_seconds": round(packed - began, 3), "verify_seconds": round(verified - packed, 3), "unpack_seconds": round(done - verified, 3)}


def make_report(groups: list[dict]) -> str:
    """Measured groups as a Markdown table."""
    names = ["group", "files", "original_bytes", "archive_bytes", "strategy", "zip_bytes", "kept", "pack_seconds", "verify_seconds", "unpack_seconds"]
    rows = [names, ["---"] * len(names), *([str(g[n]) for n in names] for g in groups)]
    return "\n".join(f"| {' | '.join(r)} |" for r in rows) + "\n"
