"""The analyzer: text to tokens, for every script.

Offsets count code points of the analyzed text; ``utf16`` turns them into UTF-16 units.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import regex

from .stemming import ZWJ, ZWNJ, persian, porter, without_joiners
from .wordlists import PREFIXES, STOP_ARABIC, STOP_CYRILLIC, STOP_LATIN, SUFFIXES

RULES_VERSION = 1
MAX_TERM = 64
FIELD_GAP = 16
#: Words that a Python worker keeps, of simple texts and of others; the frequent ones are most of a text.
CACHED, CACHED_OTHER = 131_072, 32_768
APOSTROPHES = "'’ʼ"
BIGRAM = frozenset(("CJK", "SOUTHEAST_ASIAN"))
_JOINS_DIGITS = frozenset(("LATIN", "CYRILLIC", "GREEK"))
#: Script groups and the Unicode scripts in each.
SCRIPTS = {
    "LATIN": "Latin", "ARABIC": "Arabic", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "HEBREW": "Hebrew", "HANGUL": "Hangul",
    "CJK": "Han Hiragana Katakana Bopomofo", "SOUTHEAST_ASIAN": "Thai Lao Khmer Myanmar",
}
#: Texts of these characters take a regular expression instead of the state machine.
_SIMPLE = re.compile("[\x00-\xb4\xb6-ɏ–—‘’“”…]*")
_LETTER = "A-Za-z\xaa\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_SIMPLE_RAW = re.compile(f"[0-9]*[{_LETTER}][{_LETTER}0-9]*(?:['’][{_LETTER}][{_LETTER}0-9]*)*|[0-9]+")
_LATIN_FOLD = str.maketrans({"’": "'", "ʼ": "'", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ς": "σ"})
_ARABIC_FOLD = {"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "ۀ": "ه", "ہ": "ه", "أ": "ا", "إ": "ا", "ٱ": "ا", "ؤ": "و"}
_DROPPED = "ـ‎‏﻿"


class Token(NamedTuple):
    term: str
    surface: str
    start: int
    end: int
    position: int
    script: str
    stopword: bool


@lru_cache(8192)
def _kind(c: str) -> str:
    category = unicodedata.category(c)
    return "L" if category[0] == "L" else "D" if category == "Nd" else "M" if category[0] == "M" else ""


def utf16(text: str, at: int) -> int:
    """The offset in UTF-16 units of a code point offset."""
    return at if text.isascii() else at + sum(1 for c in text[:at] if c > "￿")


def units(text: str) -> int:
    return utf16(text, len(text))


def is_mark(c: str) -> bool:
    return _kind(c) == "M"


def _digits(text: str) -> str:
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if _kind(c) == "D" and c <= "￿" else c for c in text)


def fold_generic(raw: str) -> str:
    return _digits(without_joiners(unicodedata.normalize("NFKC", raw).lower()))


def fold_latin(raw: str) -> str:
    if raw.isascii():
        folded = raw.lower()
    else:
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", raw).lower())
        folded = _digits("".join(c for c in plain if not is_mark(c)).translate(_LATIN_FOLD))
    return folded.removesuffix("'s").replace("'", "")


def fold_cyrillic(raw: str) -> str:
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", raw).lower())
    return unicodedata.normalize("NFC", _digits(plain.replace("̀", "").replace("́", ""))).replace("ё", "е")


def fold_arabic(raw: str) -> str:
    out: list[str] = []
    for c in raw:
        for x in unicodedata.normalize("NFKC", c) if "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻾" else c:
            if x in (ZWNJ, ZWJ):
                if out and out[-1] != ZWNJ:
                    out.append(ZWNJ)
            elif x in _ARABIC_FOLD:
                out.append(_ARABIC_FOLD[x])
            elif x not in _DROPPED and not is_mark(x):
                out.append(_digits(x) if _kind(x) == "D" else x.lower())
    return "".join(out).strip(ZWNJ)


@lru_cache(CACHED_OTHER)
def normalize(script: str, raw: str) -> str:
    if script == "ARABIC":
        return fold_arabic(raw)
    if script in ("LATIN", "GREEK"):
        return fold_latin(raw)
    if script == "CYRILLIC":
        return fold_cyrillic(raw)
    if script == "HEBREW":
        return "".join(c for c in unicodedata.normalize("NFD", fold_generic(raw)) if not is_mark(c))
    return fold_generic(raw)


def _word_pattern() -> str:
    """One alternative for each script group, named after it.

    A run begins with a letter of its script (or a digit) and goes on over its letters, marks and letters
    common to all scripts; digits join Latin, Cyrillic and Greek runs on either side, apostrophes
    stand inside Latin ones, joiners inside Arabic and unlisted ones.
    """
    listed = {name: "".join(rf"\p{{Script={x}}}" for x in scripts.split()) for name, scripts in SCRIPTS.items()}
    common = r"[\p{L}&&[\p{Script=Common}\p{Script=Inherited}]]"
    joiner = rf"[{ZWNJ}{ZWJ}]+"
    out = []
    for name, scripts in listed.items():
        letter = rf"[\p{{L}}&&[{scripts}]]"
        inside = rf"{letter}|{common}|\p{{M}}"
        start = letter
        if name in _JOINS_DIGITS:
            start, inside = rf"(?:\p{{Nd}}(?:\p{{Nd}}|\p{{M}}|{common})*+)?{letter}", inside + r"|\p{Nd}"
        if name == "LATIN":
            inside += rf"|[{APOSTROPHES}](?={letter})"
        if name == "ARABIC":
            inside += rf"|{joiner}(?={inside})"
        out.append(rf"(?P<{name}>{start}(?:{inside})*+)")
    out.append(rf"(?P<DIGIT>\p{{Nd}}(?:\p{{Nd}}|\p{{M}}|{common})*+)")
    unlisted = rf"[\p{{L}}--[{''.join(listed.values())}]]"
    out.append(rf"(?P<OTHER>{unlisted}(?:{unlisted}|\p{{M}}|{joiner}(?={unlisted}|\p{{M}}))*+)")
    return "|".join(out)


_WORD = regex.compile(_word_pattern(), regex.V1)


def segment(text: str) -> list[tuple[int, int, str]]:
    """Start, end and script of each word; a word never mixes scripts."""
    return [(m.start(), m.end(), m.lastgroup) for m in _WORD.finditer(text)]


def _merged(text: str, words: list[list]) -> list[list]:
    """Detached Persian affixes, joined to their words."""
    i = 0
    while i + 1 < len(words):
        a, b = words[i], words[i + 1]
        between = text[a[1] : b[0]]
        if a[2] == b[2] == "ARABIC" and between and not between.strip("  \t") and (without_joiners(a[3]) in PREFIXES or without_joiners(b[3]) in SUFFIXES):
            words[i : i + 2] = [[a[0], b[1], "ARABIC", a[3] + ZWNJ + b[3]]]
        else:
            i += 1
    return words


def _bigrams(text: str, start: int, end: int) -> list[tuple[int, int]]:
    parts: list[list[int]] = []
    for i in range(start, end):
        if parts and is_mark(text[i]):
            parts[-1][1] = i + 1
        else:
            parts.append([i, i + 1])
    if len(parts) == 1:
        return [(parts[0][0], parts[0][1])]
    return [(a[0], b[1]) for a, b in zip(parts, parts[1:], strict=False)]


def stop(script: str, surface: str) -> bool:
    if script == "LATIN":
        return surface in STOP_LATIN
    if script == "ARABIC":
        return surface in STOP_ARABIC or surface in SUFFIXES or surface in PREFIXES
    return script == "CYRILLIC" and surface in STOP_CYRILLIC


def stem(script: str, normalized: str, surface: str) -> str:
    if script == "LATIN" and surface.isascii() and surface.isalpha():
        return porter(surface)
    return persian(normalized) if script == "ARABIC" else surface


class Word(NamedTuple):
    """What a word of a simple text is, wherever it stands.  display: its form in the lexicon, if it has a place there."""

    term: str
    surface: str
    script: str
    stopword: bool
    display: str | None


@lru_cache(CACHED)
def simple_word(raw: str, stemming: bool) -> Word | None:
    """The word, None if it makes no token."""
    script = "DIGIT" if raw.isdecimal() else "LATIN"
    plain = raw.isascii()
    surface = fold_latin(raw) if plain else normalize(script, raw)
    if not surface or len(surface) > MAX_TERM or not (term := stem(script, surface, surface) if stemming else surface):
        return None
    if plain:
        return Word(term, surface, script, surface in STOP_LATIN, None if script == "DIGIT" else surface if len(surface) == len(raw) else raw.lower())
    return Word(term, surface, script, stop(script, surface), display_form(raw) if any(_kind(c) == "L" for c in surface) else None)


def simple_raws(text: str) -> list[str] | None:
    """The words of a text as they stand, in order; None if the text isn't simple."""
    return _SIMPLE_RAW.findall(text) if _SIMPLE.fullmatch(text) else None


def analyze(text: str | None, first: int = 0, stemming: bool = True) -> list[Token]:
    """The tokens of a text; positions are numbered from ``first``."""
    if not text:
        return []
    if _SIMPLE.fullmatch(text):
        found = ((m, simple_word(m[0], stemming)) for m in _SIMPLE_RAW.finditer(text))
        return [Token(w.term, w.surface, m.start(), m.end(), at, w.script, w.stopword) for at, (m, w) in enumerate((x for x in found if x[1]), first)]
    words = segment(text)
    if any(w[2] == "ARABIC" for w in words):
        joined = _merged(text, [[a, b, s, None if s in BIGRAM else normalize(s, text[a:b])] for a, b, s in words])
    else:
        joined = [[a, b, s, None if s in BIGRAM else normalize(s, text[a:b])] for a, b, s in words]
    out: list[Token] = []
    for start, end, script, normalized in joined:
        if script in BIGRAM:
            for a, b in _bigrams(text, start, end):
                term = fold_generic(text[a:b])
                out.append(Token(term, term, a, b, first + len(out), script, False))
            continue
        surface = without_joiners(normalized)
        if not surface or len(surface) > MAX_TERM or units(surface) > MAX_TERM:
            continue
        term = stem(script, normalized, surface) if stemming else surface
        if term:
            out.append(Token(term, surface, start, end, first + len(out), script, stop(script, surface)))
    return out


def display_form(raw: str) -> str:
    """How a word is shown: composed, lower case, blanks inside as joiners."""
    return re.sub("[  \t]+", ZWNJ, unicodedata.normalize("NFC", raw).lower())


def in_lexicon(token: Token) -> bool:
    return token.script not in BIGRAM and any(_kind(c) == "L" for c in token.surface)
