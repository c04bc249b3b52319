"""Names of files in an archive: which are safe everywhere, and which conflict."""

from __future__ import annotations

import re
import unicodedata
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest and deepest name, and the most files and bytes that are taken.
MOST_LENGTH, MOST_DEPTH, MOST_FILES, MOST_BYTES = 220, 16, 10_000, 64 << 40
#: Names that a system reserves for devices.
DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in "123456789¹²³")}


def safe_name(name: str) -> str:
    """The name in the form in which names are compared; ValueError if it is unsafe."""
    parts = name.split("/")
    if not name or len(name) > MOST_LENGTH or "\\" in name or len(parts) > MOST_DEPTH:
        raise ValueError(f"unsafe name: {name!r}")
    for part in parts:
        stem = part.split(".")[0].rstrip(" ").upper()
        if part in ("", ".", "..") or part[-1] in " ." or stem in DEVICES or re.search('[<>:"|?*]', part) or any(unicodedata.category(c) in ("Cc", "Cs") for c in part):
            raise ValueError(f"unsafe name: {name!r}")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())


def local_component(value: str, label: str) -> str:
    """The value, if it is one part of a safe name; ValueError, with the label, if not."""
    if not isinstance(value, str) or "/" in value:
        raise ValueError(f"{label}: not one part of a name")
    try:
        safe_name(value)
    except ValueError as e:
        raise ValueError(f"{label}: {e}") from e
    return value


def validate_names(names: list[str]) -> None:
    """ValueError if two names are the same to some system, or one is a folder of another."""
    seen = [safe_name(n) for n in names]
    if len(set(seen)) != len(seen):
        raise ValueError("names conflict")
    if set(seen) & {"/".join(n.split("/")[:i]) for n in seen for i in range(1, n.count("/") + 1)}:
        raise ValueError("a file is another's folder")


def is_safe(name: Column) -> Column:
    """safe_name() as an expression, for names without characters whose normal form matters."""
    part = "(?i)(?:con|prn|aux|nul|(?:com|lpt)[1-9¹²³]) *(?:\\..*)?"
    parts = F.split(name, "/")
    return (
        (F.length(name) > 0)
        & (F.length(name) <= MOST_LENGTH)
        & ~name.rlike(r"\\")
        & (F.size(parts) <= MOST_DEPTH)
        & ~F.exists(parts, lambda p: (p == "") | (p == ".") | (p == "..") | p.rlike("[ .]$") | p.rlike('[<>:"|?*\\x00-\\x1F\\x7F-\\x9F]') | p.rlike(f"^(?:{part})$"))
    )


def collect_sources(sources: list[str]) -> list[tuple[str, str]]:
    """(name, path) of all regular files of files and folders, by name; links are refused. A folder's files keep its name before theirs."""
    found = []
    for source in map(Path, sources):
        if any(p.is_symlink() for p in (source, *source.parents)):
            raise ValueError(f"a link: {source}")
        if source.is_file():
            found.append((source.name, str(source.resolve())))
        elif source.is_dir():
            for p in sorted(source.rglob("*")):
                if p.is_symlink():
                    raise ValueError(f"a link: {p}")
                if p.is_file():
                    found.append((f"{source.resolve().name}/{p.relative_to(source).as_posix()}", str(p.resolve())))
                elif not p.is_dir():
                    raise ValueError(f"not a regular file: {p}")
        else:
            raise ValueError(f"no such file or folder: {source}")
    if not 0 < len(found) <= MOST_FILES or sum(Path(p).stat().st_size for _, p in found) > MOST_BYTES:
        raise ValueError("1 to 10000 files of 64 TiB at most are needed")
    validate_names([n for n, _ in found])
    return sorted(found)
