"""Regions of a word that the published Snowball descriptions speak of."""

from __future__ import annotations

import re


def first_regions(word: str, vowels: str, start: int = 0) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first non-vowel that follows a vowel, and once more from there; start: R1 where it is given."""
    border = re.compile(f"[{vowels}][^{vowels}]")
    if not start:
        found = border.search(word)
        start = found.end() if found else len(word)
    found = border.search(word, start)
    return start, found.end() if found else len(word)


def ending(word: str, endings: tuple[str, ...], low: int = 0) -> str:
    """The longest of the endings, sorted by falling length, that lies behind low; else empty."""
    return next((e for e in endings if word.endswith(e) and len(word) - len(e) >= low), "")


def by_length(text: str) -> tuple[str, ...]:
    return tuple(sorted(text.split(), key=len, reverse=True))
