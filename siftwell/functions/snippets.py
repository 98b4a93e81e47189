"""Highlights and excerpts.  Ranges are half-open and count UTF-16 units of the returned text."""

from __future__ import annotations

import re
from bisect import bisect_right

from .analyzer import Token, analyze, units, utf16

LENGTH, SCANNED, ANCHORS = 240, 200_000, 256
ELLIPSIS = "…"
_BLANK, _LAST_BLANK = re.compile(r"\s"), re.compile(r"\s\S*$")


def matches(text: str, terms: set[str], stemming: bool) -> list[Token]:
    out: list[Token] = []
    last = 0
    if not terms or not text:
        return out
    for t in analyze(text[:SCANNED], 0, stemming):
        if t.term in terms and t.end > last:
            out.append(t._replace(start=max(t.start, last)))
            last = t.end
    return out


def _ranges(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(utf16(text, a), utf16(text, b)) for a, b in spans]


def highlight(text: str | None, terms: set[str], stemming: bool = True) -> tuple[str, list[tuple[int, int]]]:
    text = text or ""
    return text, _ranges(text, [(t.start, t.end) for t in matches(text, terms, stemming)])


def _focus(found: list[Token], length: int) -> Token:
    """The match whose window, which begins a quarter of its length before it, holds most distinct terms."""
    some = found[:ANCHORS]
    ends, terms = [t.end for t in some], [t.term for t in some]
    reach = [bisect_right(ends, max(0, t.start - length // 4) + length) for t in some]
    return some[max(range(len(some)), key=lambda i: len(set(terms[i : reach[i]])))]


def _window(text: str, found: list[Token], length: int) -> tuple[int, int]:
    """Where to cut a text that is longer than ``length``: at blanks, if there are any near."""
    start, least = 0, length * 2 // 3
    if found:
        focus = _focus(found, length)
        start = min(max(0, focus.start - length // 4), max(0, len(text) - length))
        end, least = min(len(text), start + length), focus.end
        if start and (blank := _BLANK.search(text, start - 1, focus.start - 1)):
            start = blank.end()
    else:
        end = min(length, len(text) - 1)
    if end < len(text) and (blank := _LAST_BLANK.search(text[least + 1 : end + 1])):
        end = least + 1 + blank.start()
    return start, end


def excerpt(text: str | None, terms: set[str], stemming: bool = True, length: int = LENGTH) -> tuple[str, list[tuple[int, int]]]:
    """About ``length`` characters around the place with most distinct terms, cut at blanks."""
    text = text or ""
    found = matches(text, terms, stemming)
    start, end = (0, len(text)) if units(text) <= length else _window(text, found, length)
    start += len(text[start:end]) - len(text[start:end].lstrip())
    body = text[start:end].strip()
    end = start + len(body)
    before = ELLIPSIS if start else ""
    out = before + body + (ELLIPSIS if end < len(text) else "")
    return out, _ranges(out, [(t.start - start + len(before), t.end - start + len(before)) for t in found if start <= t.start and t.end <= end])
