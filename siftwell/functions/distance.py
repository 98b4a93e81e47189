"""Weighted edit distance and character bigrams for spelling."""

from __future__ import annotations

from .wordlists import ALTERNATIVES


def weighted(a: str, b: str) -> float:
    """Restricted Damerau-Levenshtein distance; a confusable letter costs a half."""
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.5 if y in ALTERNATIVES.get(x, ()) else 1.0
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def bigrams(word: str) -> list[str]:
    padded = f"\x02{word}\x03"
    return list(dict.fromkeys(padded[i : i + 2] for i in range(len(padded) - 1)))


def confusable_variants(word: str) -> list[str]:
    """All words that differ from this in one confusable letter."""
    return [word[:i] + c + word[i + 1 :] for i, x in enumerate(word) for c in sorted(ALTERNATIVES.get(x, ()))]
