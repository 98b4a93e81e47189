"""Vectorised 64-bit hashes of the words and shingles of many texts at once.

A word is a run of anything but ASCII white space; A-Z count as a-z.  The texts of a batch lie in
one byte buffer, so no Python object is made for a word.  A word's hash is a polynomial of random
values of its bytes, taken from prefix sums modulo 2^64, shifted to its start and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
#: Values of the bytes if A-Z differ from a-z.
CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = CASED[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one run after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and its inverse.  Those for a usual piece stay; longer ones are made as needed."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 1 << 20:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts' bytes in pieces of about ``most``: first row, bytes, bounds (rows + 1).  Null: no bytes."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    big = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


#: Everything in ASCII but letters and digits, for words without punctuation.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words."""
    return located_words(flat, bounds)[:2]


def located_words(flat: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACE, values: np.ndarray = _VALUES) -> tuple[np.ndarray, ...]:
    """As ``words``, with the words' first and last bytes.  between: which bytes separate words; values: of the bytes."""
    n = len(flat)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), none, none
    space = between[flat]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[inner - 1] = True
    word = ~space
    start = np.flatnonzero(first & word)
    end = np.flatnonzero(last & word)
    power, inverse = _power(n)
    sums = np.cumsum(values[flat] * power[:n], dtype=np.uint64)
    h = sums[end]
    before = start > 0
    h[before] -= sums[start[before] - 1]
    return mix(h * inverse[start]), np.searchsorted(start, bounds), start, end


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes.  With fewer words, the whole sequence is one."""
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s += h[i : i + n] * _FACTORS[i]
    s = mix(s)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            yield mix(np.sum(h[a:b] * _FACTORS[: b - a], dtype=np.uint64, keepdims=True) + _FACTORS[63 - b + a : 64 - b + a])
        else:
            yield np.zeros(0, np.uint64)
