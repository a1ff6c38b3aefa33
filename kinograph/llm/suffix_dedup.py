"""Suffix-array dedup: a hash-compared suffix sort.

Anchors are minimizers: of the ``gram``-word hashes in a window, the least (the leftmost of equals). Windows that share an
anchor at the same distance are suffixes to be sorted. Two suffixes are compared by prefix polynomial hashes: a binary
search finds their longest common extension in log2(width) steps, and the next word decides. A bottom-up mergesort runs on
all anchors of a batch at once. Neighbours in the sorted order that agree in ``width`` words are verified as bytes. Segments
that are alone with their copies at an anchor are one suffix class: they are compared, as bytes, with the first of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kinograph.llm import _repeats, _text
from kinograph.llm._text import prefix_hash, range_hash

WIDTH, GRAM = 50, 12


def minimizers(gram: int) -> _repeats.Anchors:
    def find(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.arange(len(h) - gram + 1)
        g = _text.mix(range_hash(prefix_hash(h), i, i + gram))
        least, span, reach = i, 1, width - gram + 1
        while span < reach:
            step = min(span, reach - span)
            a, b = least[:-step], least[step:]
            least = np.where(g[b] < g[a], b, a)
            span += step
        return least, least, g[least]

    return find


def extension(h: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Words that the suffixes from a and from b have in common, up to width."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), width)
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = range_hash(h, a, a + mid) == range_hash(h, b, b + mid)
        lo, hi = np.where(same & open_, mid, lo), np.where(same | ~open_, hi, mid - 1)
    return lo


def suffix_sort(words: np.ndarray, at: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """The order of the suffixes from at within buckets: a bottom-up mergesort, each merge by binary search for ranks."""
    h = prefix_hash(words)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    size = np.diff(np.r_[head, len(b)])
    begin, end = np.repeat(head, size), np.repeat(head + size, size)
    rel = np.arange(len(b)) - begin
    run = 1
    while len(size) and run < size.max():
        # elements whose bucket has a second run to merge with
        mine = (rel // run) * run
        other = mine + np.where((rel // run) % 2, -run, run)
        move = np.flatnonzero((end - begin > run) & (begin + other < end))
        x, left = at[order[move]], (rel[move] // run) % 2 == 0
        base = begin[move] + other[move]
        lo, hi = np.zeros(len(move), np.int64), np.minimum(run, end[move] - base)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            y = at[order[base[live] + mid]]
            same = extension(h, x[live], y, width)
            equal = same == width
            step = np.minimum(same, width - 1)
            less = ~equal & (words[y + step] < words[x[live] + step])
            right = less | (equal & ~left[live])
            lo[live], hi[live] = np.where(right, mid + 1, lo[live]), np.where(right, hi[live], mid)
        to = begin[move] + np.minimum(mine[move], other[move]) + (rel[move] - mine[move]) + lo
        new = order.copy()
        new[to] = order[move]
        order, run = new, run * 2
    return order


def groups(words: np.ndarray, at: np.ndarray, bucket: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted within buckets, and whether each agrees with the one before in width words."""
    order = suffix_sort(words, at, bucket, width)
    alike = np.zeros(len(order), bool)
    near = np.flatnonzero(bucket[order[1:]] == bucket[order[:-1]])
    alike[near + 1] = extension(prefix_hash(words), at[order[near]], at[order[near + 1]], width) == width
    return order, alike


def suffix_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, first_word, end_word, again): all spans of words that windows of ``width`` repeated words cover.

    Words are runs of characters other than ASCII white space. A window is repeated if the same words follow each other
    anywhere else, in another document or elsewhere in the same one. again is false for the windows that are first in the
    order of doc_id and position, true for all later ones; overlapping or touching windows of one kind make one span.
    Documents with fewer than ``width`` words, NULL and empty texts have none. Rows equal in doc_id and text are one
    document; of different texts with one doc_id, the order is that of their hashes. A NULL doc_id comes last. An empty
    table gives no rows; other columns are not looked at.
    """
    runs = _repeats.repeated_runs(docs, width, minimizers(gram), groups)
    return _repeats.repeated_spans(runs, width).select("doc_id", "first_word", "end_word", "again")


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs, with all its columns, whose texts lack every span that suffix_repeats calls again.

    n_chars, where there is such a column, follows the text. A document of which only white space is left goes; one that
    was empty or NULL before stays.
    """
    spans = _repeats.repeated_spans(_repeats.repeated_runs(docs, width, minimizers(gram), groups), width)
    return _repeats.without_repeats(docs, spans)


SQL = _repeats.sql(WIDTH)
