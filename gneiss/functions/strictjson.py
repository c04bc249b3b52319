"""JSON as stored in an archive: one canonical writing, and a reader that refuses what two readers could take differently."""

from __future__ import annotations

import json

#: Fixed value: the most characters of a stored JSON text.
MOST_TEXT = 8192


def dump(value: object) -> str:
    """ASCII with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def load(text: str, most: int = MOST_TEXT) -> object:
    """The value of a JSON text; ValueError if it is too long or deep, malformed, or has a key twice in one object."""
    if not isinstance(text, str) or len(text) > most:
        raise ValueError("JSON text expected, of bounded length")
    try:
        return json.loads(text, object_pairs_hook=_once)
    except RecursionError as e:
        raise ValueError("JSON too deep") from e
