"""Substring dedup by recompression.

Rounds name runs of one symbol (a, k), then pairs (a, b) whose left symbol falls, by a bit of its hash, in the left half of
the alphabet and whose right one in the right half. A name is a 64-bit hash of what it stands for, so it is the same in
every document without any exchange between them, and all rounds of a text happen where the text is read. Each symbol
carries the range of words on which its making depended. A symbol whose range lies within a window is *interior*: equal
windows have the same interior symbols at the same places. The window's anchor is its highest interior symbol (of several,
the one with the least name, then the leftmost), and its key that symbol's whole range, which every such window has. Windows
without an interior symbol of level LEAST or more, such as those within a run of one word, are their own anchors.

Spark then groups segments by that shared symbol, and verifies their words as bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kinograph.llm import _repeats
from kinograph.llm._text import U, mix, prefix_hash, range_hash

WIDTH, ROUNDS = 50, 6
#: Lower symbols are common, and a common anchor would bring too many segments together.
LEAST = 3
_A, _B = U(0xD6E8FEB86659FD93), U(0xA5CB9243F0AEF1B5)


class Symbols:
    """name, words from start to end, and the range lo to hi of words that made it so; doc is the text's number."""

    def __init__(self, name, start, end, lo, hi, doc):
        self.name, self.start, self.end, self.lo, self.hi, self.doc = name, start, end, lo, hi, doc


def _around(s: Symbols, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the next symbol is in the same text; lo of the one before and hi of the one after, beyond the text at its ends."""
    near = s.doc[1:] == s.doc[:-1]
    before, after = first[s.doc] - 1, first[s.doc + 1] + 1
    before[1:][near] = s.lo[:-1][near]
    after[:-1][near] = s.hi[1:][near]
    return near, before, after


def name_runs(s: Symbols, first: np.ndarray, level: int) -> Symbols:
    near, before, after = _around(s, first)
    head = np.flatnonzero(np.r_[True, (s.name[1:] != s.name[:-1]) | ~near])
    k = np.diff(np.r_[head, len(s.name)])
    last = head + k - 1
    name = np.where(k > 1, mix(s.name[head] * _A + k.astype(U) * _B + U(2 * level + 1)), s.name[head])
    return Symbols(name, s.start[head], s.end[last], before[head], after[last], s.doc[head])


def name_pairs(s: Symbols, first: np.ndarray, level: int) -> Symbols:
    near, before, after = _around(s, first)
    left = (mix(s.name + U((level + 1) * int(_A) % (1 << 64))) & U(1)) == 1
    pair = np.r_[left[:-1] & ~left[1:] & near, False]
    second = np.r_[False, pair[:-1]]
    lo = np.where(~left & ~second, before, s.lo)
    hi = np.where(left & ~pair, after, s.hi)
    i = np.flatnonzero(~second)
    j = i + pair[i]
    name = np.where(pair[i], mix(mix(s.name[i] * _B + U(2 * level)) + s.name[j] * _A), s.name[i])
    return Symbols(name, s.start[i], s.end[j], lo[i], hi[j], s.doc[i])


def levels(h: np.ndarray, first: np.ndarray, rounds: int) -> list[tuple[int, Symbols]]:
    """The levels from LEAST on, with their numbers."""
    i = np.arange(len(h))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = Symbols(h, i, i + 1, i, i + 1, doc)
    out = []
    for r in range(rounds):
        s = name_pairs(name_runs(s, first, r) if r % 3 == 0 else s, first, r)
        if r + 1 >= LEAST:
            out.append((r + 1, s))
    return out


def interior_anchors(rounds: int) -> _repeats.Anchors:
    def find(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(h) - width + 1
        at, place, key = (np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, U))
        open_ = _repeats.windows_of(first, width)
        words = prefix_hash(h)
        for level, s in reversed(levels(h, first, rounds)):
            lo, hi = np.searchsorted(s.lo, open_), np.searchsorted(s.hi, open_ + width, "right")
            has = hi > lo
            w, lo, hi = open_[has], lo[has], hi[has]
            tables, span = [np.arange(len(s.name))], 1
            while len(w) and 2 * span <= int((hi - lo).max()):
                a, b = tables[-1][:-span], tables[-1][span:]
                tables.append(np.where(s.name[b] < s.name[a], b, a))
                span *= 2
            best = np.zeros(len(w), np.int64)
            power = np.frexp((hi - lo).astype(float))[1] - 1
            for k, t in enumerate(tables):
                m = np.flatnonzero(power == k)
                a, b = t[lo[m]], t[hi[m] - (1 << k)]
                best[m] = np.where(s.name[b] < s.name[a], b, a)
            at[w], place[w], key[w] = best * 64 + level, s.start[best], range_hash(words, s.lo[best], s.hi[best])
            open_ = open_[~has]
            if not len(open_):
                break
        at[open_], place[open_], key[open_] = open_ * 64, open_, range_hash(words, open_, open_ + width)
        return at, place, key

    return find


def groups(words: np.ndarray, at: np.ndarray, bucket: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in the order of buckets and of the hash of all their words."""
    name = range_hash(prefix_hash(words), at, at + width)
    order = np.lexsort((name, bucket))
    return order, np.r_[False, (bucket[order[1:]] == bucket[order[:-1]]) & (name[order[1:]] == name[order[:-1]])]


def substring_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, first_word, end_word, again): all spans of words that windows of ``width`` repeated words cover.

    Words are runs of characters other than ASCII white space. A window is repeated if the same words follow each other
    anywhere else, in another document or elsewhere in the same one. again is false for the windows that are first in the
    order of doc_id and position, true for all later ones; overlapping or touching windows of one kind make one span.
    Documents with fewer than ``width`` words, NULL and empty texts have none. Rows equal in doc_id and text are one
    document; of different texts with one doc_id, the order is that of their hashes. A NULL doc_id comes last. An empty
    table gives no rows; other columns are not looked at.
    """
    runs = _repeats.repeated_runs(docs, width, interior_anchors(rounds), groups)
    return _repeats.repeated_spans(runs, width).select("doc_id", "first_word", "end_word", "again")


def substring_dedup(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """docs, with all its columns, whose texts lack every span that substring_repeats calls again; emptied documents go."""
    spans = _repeats.repeated_spans(_repeats.repeated_runs(docs, width, interior_anchors(rounds), groups), width)
    return _repeats.without_repeats(docs, spans)


SQL = _repeats.sql(WIDTH)
