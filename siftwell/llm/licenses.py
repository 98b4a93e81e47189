"""License scans: winnowed fingerprints pick candidates, local alignment confirms them.

A word is a run of letters and digits, in lower case for A-Z.  The hashes of a template's k-word grams are
winnowed (the smallest of each ``window`` in a row is kept) and go into an inverted index, gram -> templates.  The grams of whole documents are looked up in it, a batch of texts at once; as every gram of the
document is looked up, winnowing the templates alone loses none.  The text around a template's hits is aligned
with it, without a band, and again beside each match until no hit is left; a match reports the share
of the template's words that the alignment covers, and the span of the text.  Windows are as long as a few
templates, so the time is linear in the text.

The templates are a fixed list in the library, the only thing that tasks share.

Defined results.  Null or empty text: no match.  Null or repeated ids, repeated rows: each row is scanned by itself.
Empty table: empty result.  Extra columns: ignored.  Where matches overlap, the one with more matched words
stays (ties: greater coverage, then name).
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import small_batches
from .license_texts import TEMPLATES


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g += h[i : i + n] * hashing._FACTORS[i]
    return hashing.mix(g)


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return hashing.located_words(raw, np.array([0, len(raw)]), hashing.MARKS)[0]


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """Places of the smallest gram of each ``window`` in a row, the last of equals."""
    if len(grams) <= window:
        return [len(grams) - 1 - int(grams[::-1].argmin())] if len(grams) else []
    return sorted({i + window - 1 - int(grams[i : i + window][::-1].argmin()) for i in range(len(grams) - window + 1)})


def align(template: np.ndarray, text: np.ndarray, need: int) -> tuple[int, int, int] | None:
    """Matched words, first and last matched place in text, of the best alignment with ``need`` matched words; None if there is none.

    A match scores 2, a gap or a difference -1; the alignment is local, and of equals the first stays.
    Score and matched words are one number, compared in this order.
    """
    unit, n = np.int64(1 << 32), len(text)
    place = np.arange(n, dtype=np.int64)
    slope = place * unit
    row, first = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
    best, found = need, None
    for word in template:
        same = text == word
        step = row[:-1] + np.where(same, 2 * unit + 1, -unit)
        down = row[1:] - unit
        own = np.where(step >= down, first[:-1], first[1:])
        now = np.maximum(step, down)
        own = np.where(same & (own < 0), place, own)
        low = now < unit
        now[low], own[low] = 0, -1
        slid = now + slope
        top = np.maximum.accumulate(slid)
        source = np.maximum.accumulate(np.where(slid == top, place, 0))
        own, now = own[source], top - slope
        low = now < unit
        now[low], own[low] = 0, -1
        ends = np.flatnonzero(same & ((now & (unit - 1)) >= need) & (now > best))
        if len(ends):
            j = int(ends[now[ends].argmax()])
            best, found = int(now[j]), (int(now[j] & (unit - 1)), int(own[j]), j)
        row[1:], first[1:] = now, own
    return found


class LicenseScan:
    def __init__(self, *, templates: dict[str, str] | None = None, gram: int = 3, window: int = 3, coverage: float = 0.75, text: str = "text", id_col: str = "doc_id") -> None:
        self.gram, self.window, self.coverage = gram, window, coverage
        self.text, self.id_col = text, id_col
        self.names = sorted(templates or TEMPLATES)
        self.words = [_words((templates or TEMPLATES)[n]) for n in self.names]
        self.kinds = [np.unique(w, return_counts=True) for w in self.words]
        index: dict[int, set[int]] = defaultdict(set)
        for t, words in enumerate(self.words):
            grams = _grams(words, gram)
            for at in winnow(grams, window):
                index[int(grams[at])].add(t)
        self.index = dict(index)

    def _found(self, t: int, words: np.ndarray, at: list[int]) -> list[tuple[int, int, int]]:
        """First and last word and matched words of a template's matches, which don't overlap; at: the places of its hits, in order.

        An alignment through a hit lies within three template lengths of it, as its score is positive throughout.
        Hits within a template's length of each other are looked at in one window that holds all that; each match
        is cut out, and what it leaves beside further hits is aligned again.
        """
        template, n = self.words[t], len(self.words[t])
        kinds, most = self.kinds[t]
        need, reach = max(1, math.ceil(self.coverage * n)), 3 * n + self.gram
        spans: list[tuple[int, int, int]] = []
        k = 0
        while k < len(at):
            stop = bisect_right(at, at[k] + n, k)
            own, low, high = at[k:stop], max(0, at[k] - reach), min(len(words), at[stop - 1] + reach)
            todo, k = [], stop
            for x in reversed(spans[bisect_left(spans, (low - 2 * reach,)) :]):
                if x[0] < high and x[1] >= low:
                    todo.append((x[1] + 1, high))
                    high = x[0]
            todo.append((low, high))
            while todo:
                low, high = todo.pop()
                if low >= high or not any(low - self.gram < j < high for j in own):
                    continue
                text = words[low:high]
                spot = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
                if np.minimum(np.bincount(spot[kinds[spot] == text], minlength=len(kinds)), most).sum() < need:
                    continue  # too few of the template's words
                got = align(template, text, need)
                if got:
                    m, first, last = got[0], low + got[1], low + got[2]
                    insort(spans, (first, last, m))
                    todo += [(low, first), (last + 1, high)]
        return spans

    def matches(self, words: np.ndarray, at: np.ndarray, grams: np.ndarray) -> list[tuple[int, int, int, int]]:
        """template, matched words, first and last word of the matches in one text; at: places of the grams that hit."""
        places = defaultdict(list)
        for j in at.tolist():
            for t in self.index[int(grams[j])]:
                places[t].append(j)
        found = [(t, m, first, last) for t, own in places.items() for first, last, m in self._found(t, words, own)]
        found.sort(key=lambda x: (-x[1], -x[1] / len(self.words[x[0]]), self.names[x[0]]))
        kept: list[tuple[int, int, int, int]] = []  # first, last, template, matched
        for t, m, first, last in found:
            i = bisect_left(kept, (first,))
            if (i == 0 or kept[i - 1][1] < first) and (i == len(kept) or last < kept[i][0]):
                kept.insert(i, (first, last, t, m))
        return [(t, m, first, last) for first, last, t, m in kept]

    def scan(self, docs: DataFrame) -> DataFrame:
        """A row per match: doc_id, license, coverage, matched_words, start, stop (code points, end exclusive)."""
        small_batches(docs.sparkSession)
        known = np.array(sorted(self.index), np.uint64)
        kinds = [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for first, flat, bounds in hashing.pieces(batch.column(1)):
                    h, at, start, end = hashing.located_words(flat, bounds, hashing.MARKS)
                    grams = _grams(h, self.gram)
                    hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams)
                    rows = np.searchsorted(at, hits, side="right") - 1
                    whole = hits + self.gram <= at[rows + 1] if len(hits) else hits.astype(bool)
                    hits, rows = hits[whole], rows[whole]
                    for r in np.unique(rows):
                        a, b = at[r], at[r + 1]
                        points = np.cumsum(flat[bounds[r] : bounds[r + 1]] & 0xC0 != 0x80)
                        for t, m, x, y in self.matches(h[a:b], hits[rows == r] - a, grams[a:]):
                            begin, stop = int(points[start[a + x] - bounds[r]]) - 1, int(points[end[a + y] - bounds[r]])
                            out.append({"doc_id": batch.column(0)[first + int(r)].as_py(), "license": self.names[t], "coverage": m / len(self.words[t]), "matched_words": m, "start": begin, "stop": stop})
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

        rows = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))
        return rows.mapInArrow(task, "doc_id long, license string, coverage double, matched_words long, start long, stop long")
