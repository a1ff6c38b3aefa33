"""Brute-force versions in plain Python, and a table with everything that is awkward."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

SPACES = " \t\n\r\f\v"
LONG = " ".join(f"w{i}x{i * 7919 % 1009}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, th bigint, anchor string, size int, id string, lines string, c0 int, absent boolean"


def messy(spark):
    texts = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha beta"), (None, "alpha beta"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG), (8, "Ünïcödé ▁ 日本\n\nnoch <s> mehr\x00?")]
    langs = ["en", "en", "fr", None, "en", "xx", None, "fr", "fr", "de"]
    rows = [(i, t, lang, len(t) if t is not None else None, 1, "a", None, "x", "y", 0, None) for (i, t), lang in zip(texts, langs)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(f"[^{SPACES}]+", text or "")


def spans(docs, width):
    """docs: {doc_id: text}."""
    places = defaultdict(list)
    for d in sorted(docs):
        w = words(docs[d])
        for i in range(len(w) - width + 1):
            places[tuple(w[i : i + width])].append((d, i))
    hits = defaultdict(list)
    for at in places.values():
        if len(at) > 1:
            for k, (d, i) in enumerate(at):
                hits[d, k > 0].append(i)
    out = set()
    for (d, again), starts in hits.items():
        first = last = None
        for i in sorted(starts):
            if first is not None and i > last + width:
                out.add((d, first, last + width, again))
                first = None
            first, last = (i if first is None else first), i
        out.add((d, first, last + width, again))
    return out


def cut_repeats(docs, width):
    gone = defaultdict(list)
    for d, a, b, again in spans(docs, width):
        if again:
            gone[d].append((a, b))
    out = {}
    for d, text in docs.items():
        if d in gone:
            starts = [m.start() for m in re.finditer(f"[^{SPACES}]+", text)] + [len(text)]
            for a, b in sorted(gone[d], reverse=True):
                text = text[: starts[a]] + text[starts[b] :]
            if not text.strip(SPACES):
                continue
        out[d] = text
    return out


def line_dedup(docs):
    seen, out = set(), {}
    for d in sorted(docs):
        if docs[d] is None:
            out[d] = None
            continue
        left, fresh, real = [], False, False
        for line in docs[d].split("\n"):
            if not line.strip(SPACES):
                left.append(line)
                continue
            real = True
            if line not in seen:
                seen.add(line)
                left.append(line)
                fresh = True
        if fresh or not real:
            out[d] = "\n".join(left)
    return out


def near_groups(prints, distance, confirm):
    """From {doc_id: (fa, fb)}: {doc_id: kept_doc_id} of removed documents, and all near pairs of distinct prints."""
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    mask = (1 << 64) - 1
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if ((prints[a][0] ^ prints[b][0]) & mask).bit_count() <= distance and ((prints[a][1] ^ prints[b][1]) & mask).bit_count() <= confirm:
                pairs.add((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids if find(d) != d}, pairs


def shingle_copies(docs, least, width=5):
    """From {doc_id: text}: the doc_ids of which a lesser one has this Jaccard of word shingles at least, and all such pairs."""
    sets, places, common = {}, defaultdict(list), defaultdict(int)
    for d in sorted(docs):
        w = words((docs[d] or "").lower())
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        for x in sets[d]:
            for e in places[x]:
                common[e, d] += 1
            places[x].append(d)
    pairs = {p for p, n in common.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    return {d for _, d in pairs}, pairs


def pack(docs, capacity):
    """(bin_id, doc_id, piece, first_word, n_words, bin_offset) of docs with unique doc_ids, round by round."""
    items = []
    for d, text in docs.items():
        n = len(words(text))
        items += [(min(capacity, n - p * capacity), (d, p)) for p in range(math.ceil(n / capacity))]
    placed = [(s, i, i, 0) for s, i in items if 2 * s > capacity]
    waiting = [(s, i) for s, i in items if 2 * s <= capacity]
    gaps = {i: capacity - s for s, i, *_ in placed if capacity > s}
    step = 0
    while waiting:
        step += 1
        most, n = max(waiting)[0], len(waiting)
        rows = [(-s, 1, i, 0) for s, i in waiting]
        for i, room in gaps.items():
            q = min(max(1, room // most), n)
            rows += [(-(room // q), 0, i, k) for k in range(1, q + 1)]
        free, left, took = [], [], defaultdict(int)
        for s, kind, i, _ in sorted(rows):
            if kind == 0:
                free.append(i)
            elif free:
                b = free.pop()
                placed.append((-s, i, b, 2 * step - 1))
                took[b] -= s
            else:
                left.append((-s, i))
        gaps = {i: r - took[i] for i, r in gaps.items() if r > took[i]}
        if not left:
            break
        least = min(left)[0]
        usable = 0 if len(left) == n else sum(r for r in gaps.values() if r >= least)
        k = min(len(left), max(0, math.ceil((sum(s for s, _ in left) - usable) / capacity)))
        left.sort(key=lambda x: (-x[0], x[1]))
        for s, i in left[:k]:
            placed.append((s, i, i, 2 * step))
            gaps[i] = capacity - s
        waiting = left[k:]
    number = {b: k for k, b in enumerate(sorted(i for _, i, b, _ in placed if i == b))}
    out, at = set(), defaultdict(int)
    for s, (d, p), b, r in sorted(placed, key=lambda x: (x[2], x[3], -x[0], x[1])):
        out.add((number[b], d, p, p * capacity, s, at[b]))
        at[b] += s
    return out


def shards(docs, limit, bits=60):
    """docs: [(doc_id, text)]."""
    rows = [(d, int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for d, t in docs]
    out = []

    def split(rows, depth, prefix):
        total = sum(r[2] for r in rows)
        if total <= limit or depth == bits:
            out.extend((d, depth, prefix, total) for d, _, _ in rows)
            return
        for bit in (0, 1):
            if part := [r for r in rows if (r[1] >> (bits - depth - 1)) & 1 == bit]:
                split(part, depth + 1, prefix * 2 + bit)

    split(rows, 0, 0)
    return out


def passages(seed=1, n=40, width=50):
    """Texts of a small alphabet that share passages, repeat themselves and have runs of one word."""
    r = random.Random(seed)
    make = lambda k, a: [f"{r.choice('abcdefgh')}{r.randrange(a)}" for _ in range(k)]
    shared = [make(r.randrange(width - 1, 3 * width), 40) for _ in range(6)]
    docs = {}
    for d in range(n):
        w = []
        for _ in range(r.randrange(1, 6)):
            w += r.choice([make(r.randrange(0, 90), 300), r.choice(shared), ["la"] * r.randrange(0, 130), r.choice(shared)[3:]])
        docs[d] = "".join(x + r.choice([" ", "\n", "\t "]) for x in w)
    return docs
