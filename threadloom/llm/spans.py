"""Character spans of one text: choosing disjoint ones by rank, and putting replacements in."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable


def disjoint(ranked: Iterable[tuple]) -> list[tuple]:
    """Of (start, end, ...) spans in order of preference, those that overlap none before them; in order of start."""
    taken: list[tuple] = []
    for span in ranked:
        at = bisect_left(taken, span)
        if (at == 0 or taken[at - 1][1] <= span[0]) and (at == len(taken) or span[1] <= taken[at][0]):
            insort(taken, span)
    return taken


def splice(text: str, parts: Iterable[tuple[int, int, str]]) -> str:
    """The text with each (start, end, replacement) put in; the parts are disjoint and in order."""
    out, last = [], 0
    for a, b, into in parts:
        out += [text[last:a], into]
        last = b
    return "".join([*out, text[last:]])
