"""Words of UTF-8 texts: runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(data: bytes | None) -> list[bytes]:
    return WORD.findall(data.lower()) if data else []


def phrase(text: str) -> tuple[bytes, ...]:
    return tuple(words_of(text.encode()))


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions inside any of the half-open spans."""
    total, end = 0, 0
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total

