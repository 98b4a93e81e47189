"""Token ids of many texts at once, by a byte-level, lower-casing BPE tokenizer with word ends that drops white space.

With such a tokenizer a text's ids are those of its parts between ASCII white space, one after another.  Parts are told
apart by 64-bit hashes of their bytes and encoded once for each worker.  Latin letters with marks after them are split
in an evident way, so they are merged here: all words of one length at once, a merge for each word in each turn, the
pairs' ranks found in a hash table.  All other parts go to the tokenizer itself, many in one call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import hashing

#: Words whose ids a worker keeps.
CACHE_WORDS = 900_000
#: Longest word, in bytes, that is merged here.
LONGEST = 48
#: Bytes of a text that are handled at once.
SEGMENT = 1 << 20

#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = [chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)]
_ROTATE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.iinfo(np.int32).max
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '.,!?;:"#$%&()*+-/=@[]^_`{}~' + chr(92)]] = True  # not those of contractions and special tokens
_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])
#: Second bytes, after 0xC3, of letters; the others are signs.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


class Merges:
    """A BPE model's symbols and merges as arrays."""

    def __init__(self, model: dict) -> None:
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.inner, self.last = (np.array([vocabulary[c + e] for c in _BYTES], np.int32) for e in ("", end))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = self._key(*(np.array([vocabulary[p[i]] for p in pairs], np.int32) for i in (0, 1)))
        bits = (4 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.ranks = np.full((1 << bits) + 64, np.iinfo(np.uint64).max), np.full((1 << bits) + 64, _NEVER, np.int32)
        left, at = np.arange(len(keys)), (keys * _ROTATE >> self.shift).astype(np.int64)
        while len(left):  # linear probing, all at once: of those at a free slot the first takes it
            free = self.ranks[at] == _NEVER
            slots, first = np.unique(at[free], return_index=True)
            taken = left[free][first]
            self.keys[slots], self.ranks[slots] = keys[taken], taken
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, at = left[stay], at[stay] + 1

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self._key(a, b)
        at = (key * _ROTATE >> self.shift).astype(np.int64)
        out = np.full(key.shape, _NEVER, np.int32)
        fits = self.keys[at] == key
        out[fits] = self.ranks[at[fits]]
        left = np.nonzero(~fits & (self.ranks[at] != _NEVER))
        key, at = key[left], at[left] + 1
        while len(key):
            fits = self.keys[at] == key
            out[tuple(x[fits] for x in left)] = self.ranks[at[fits]]
            going = ~fits & (self.ranks[at] != _NEVER)
            left, key, at = tuple(x[going] for x in left), key[going], at[going] + 1
        return out

    def tokens(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``starts`` of the bytes, one word after another, and how many each has."""
        counts, found = np.zeros(len(starts), np.int64), []
        for length in np.unique(lengths):
            of = np.flatnonzero(lengths == length)
            for i in range(0, len(of), 20_000):
                some = of[i : i + 20_000]
                own = flat[starts[some, None] + np.arange(length)]
                ids = self.inner[own]
                ids[:, -1] = self.last[own[:, -1]]
                for rows, made in self._merged(ids):
                    counts[some[rows]] = made.shape[1]
                    found.append((some[rows], made))
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for words, made in found:
            out[first[words, None] + np.arange(made.shape[1])] = made
        return out, counts

    def _merged(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, rank = np.arange(len(ids)), self.rank(ids[:, :-1], ids[:, 1:])
        while len(words):
            width = ids.shape[1]
            if width == 1:
                yield words, ids
                return
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            going = best != _NEVER
            if not going.all():
                yield words[~going], ids[~going]
                words, ids, rank, at, best = words[going], ids[going], rank[going], at[going], best[going]
            rows, cut = np.arange(len(words)), at[:, None]
            ids = np.where(np.arange(width - 1) <= cut, ids[:, :-1], ids[:, 1:])
            ids[rows, at] = self.made[best]
            rank = np.where(np.arange(width - 2) < cut, rank[:, :-1], rank[:, 1:])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            rank[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])


class WordTokens:
    """A tokenizer file's ids for texts, with a cache of words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(json.loads(self.tokenizer.to_str())["model"])
        self._clear()

    def _clear(self) -> None:
        self.known, self.first, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.size = 0

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids."""
        for _, flat, bounds in hashing.pieces(texts, SEGMENT):
            if len(flat) <= 2 * SEGMENT:
                ids, ends = self._segment(flat, bounds)
                yield from (ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
            else:  # one long text: cut at white space
                at = np.flatnonzero(hashing.SPACE[flat])
                cuts = np.unique(np.concatenate([[0], at[np.minimum(np.searchsorted(at, np.arange(SEGMENT, len(flat), SEGMENT)), len(at) - 1)] if len(at) else [], [len(flat)]])).astype(np.int64)
                yield np.concatenate([self._segment(flat[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def _segment(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, at, start, end = hashing.located_words(flat, bounds, values=hashing.CASED)
        names, first, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, names)
        have = np.zeros(len(names), bool)
        have[place < len(self.known)] = self.known[place[place < len(self.known)]] == names[place < len(self.known)]
        if len(self.known) + np.count_nonzero(~have) > CACHE_WORDS:
            self._clear()
            have[:] = False
            place[:] = 0
        new = np.flatnonzero(~have)
        if len(new):
            ids, counts = self._encode(flat, start[first[new]], end[first[new]] + 1 - start[first[new]])
            self.known = np.insert(self.known, place[new], names[new])
            self.first = np.insert(self.first, place[new], self.size + np.cumsum(counts) - counts)
            self.counts = np.insert(self.counts, place[new], counts)
            if self.size + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.size], np.zeros(self.size + 2 * len(ids), np.uint32)])
            self.ids[self.size : self.size + len(ids)] = ids
            self.size += len(ids)
            place = np.searchsorted(self.known, names)
        counts = self.counts[place][which]
        out = self.ids[hashing.ragged(self.first[place][which], counts)]
        return out, np.concatenate([[0], np.cumsum(counts)])[at]

    def _encode(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one word after another, and how many each has."""
        own = flat[hashing.ragged(starts, lengths)].copy()
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        after = np.zeros(len(own), bool)
        after[1:] = own[:-1] == 0xC3
        after &= _SECOND[own]
        lead = np.zeros(len(own), bool)
        lead[:-1] = after[1:]
        letter, mark = _LETTER[own] | after | lead, _MARK[own]
        back = np.zeros(len(own), bool)
        back[1:] = mark[:-1] & letter[1:]
        back[bounds[:-1]] = False
        bad = np.concatenate([[0], np.cumsum(~(letter | mark) | back)])
        letters = np.concatenate([[0], np.cumsum(letter)])
        n_letters = letters[bounds[1:]] - letters[bounds[:-1]]
        plain = (bad[bounds[1:]] == bad[bounds[:-1]]) & (n_letters > 0) & (lengths <= LONGEST)
        own[(own >= 65) & (own <= 90)] += 32
        own[after & (own < 0x9F)] += 32

        counts, parts = np.zeros(len(starts), np.int64), []
        words = np.flatnonzero(plain)
        n_marks = (lengths - n_letters)[words]
        two = n_marks > 0
        ids, each = self.merges.tokens(own, np.concatenate([bounds[words], bounds[words[two]] + n_letters[words[two]]]), np.concatenate([n_letters[words], n_marks[two]]))
        first = np.cumsum(each) - each
        counts[words] = each[: len(words)]
        counts[words[two]] += each[len(words) :]
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            texts = [flat[starts[w] : starts[w] + lengths[w]].tobytes().decode() for w in some]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            at = np.fromiter((x for x, _ in got.offsets), np.int64, len(got))
            stops = np.searchsorted(at, begins)
            counts[some] = np.diff(stops)
            parts.append(np.array(got.ids, np.uint32))
        out, to = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        n = each[: len(words)]
        out[hashing.ragged(to[words], n)] = ids[hashing.ragged(first[: len(words)], n)]
        out[hashing.ragged(to[words[two]] + n[two], each[len(words) :])] = ids[hashing.ragged(first[len(words) :], each[len(words) :])]
        out[hashing.ragged(to[rest], counts[rest])] = np.concatenate([*parts, np.zeros(0, np.uint32)])
        return out, counts
