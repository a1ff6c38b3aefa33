"""Encoding and decoding with merge-type SentencePiece vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they would make, then by place: the
best pair is merged, its neighbours enter the agenda, until no pair makes a piece. Symbols that are no piece fall back to
their bytes. No piece reaches across a word start, so texts are cut there (the vocabulary is checked for it), and each
distinct word of an Arrow batch is encoded once, unless it was met before. The agendas of all new words are worked off
together: a sweep takes the best entry of each word's agenda, in NumPy. Words too long for that have a heap of their own.
Each Arrow batch is encoded by the sentencepiece library as well, whole texts at a time, and compared.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm import _text as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
#: Words that are remembered in each Python worker, in each of two generations: when the young one is full, the old one goes.
REMEMBERED = 200_000
#: Longer words (in characters) have an agenda of their own.
LONG = 64
NONE = np.iinfo(np.int32).max


def fields(proto: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = proto[at]
            x, shift, at = x | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return x

    while at < len(proto):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, proto[at : at + n]
        at += n


def require_merge_type(proto: bytes) -> None:
    """ValueError unless the model merges pairs, leaves texts as they are and has no pieces that users defined."""
    for number, value in fields(proto):
        if number == 1 and dict(fields(value)).get(3, 1) == 4:
            raise ValueError("the vocabulary has pieces that users defined")
        if number == 2:
            trainer = dict(fields(value))
            if trainer.get(3, 1) != 2:
                raise ValueError("the vocabulary is not of the merge type")
            if trainer.get(24, 0):
                raise ValueError("the vocabulary has white space as a suffix")
        if number == 3:
            spec = dict(fields(value))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("the vocabulary normalises texts")


class Codec:
    def __init__(self, proto: bytes):
        import sentencepiece

        require_merge_type(proto)
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes_ = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this vocabulary reaches across a word start")
        self.dummy = bool(sp.encode("a", out_type=str)[0].startswith(SPACE))
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in "\n\r\t" if not any(c in p for p in self.ids)]] = True
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.r_[0, np.cumsum([len(x) for x in raw])]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """Symbols are pieces and the characters of pieces; for each pair of symbols that makes a piece, its rank and that piece."""
        symbols = {p: i for i, p in enumerate(self.ids)}
        for p in self.ids:
            for c in p:
                symbols.setdefault(c, len(symbols))
        self.n_symbols = len(symbols)
        scores = sorted({-x for x in self.scores.values()})
        rank = dict(zip(scores, range(len(scores))))
        pairs = {}
        for p in self.ids:
            for i in range(1, len(p)):
                a, b = symbols.get(p[:i]), symbols.get(p[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[-self.scores[p]], symbols[p])
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), NONE], np.int32)
        self.pair_piece = np.array([*(pairs[k][1] for k in keys), -1], np.int64)
        top = max((ord(s) for s in symbols if len(s) == 1), default=0)
        self.of_char = np.full(top + 2, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        out = [array("i", self.fallback(s)) for s in symbols]
        self.symbol_ids = np.frombuffer(b"".join(x.tobytes() for x in out), np.int32)
        self.symbol_at = np.r_[0, np.cumsum([len(x) for x in out])]

    def fallback(self, symbol: str) -> list[int]:
        """A piece's id, or, where symbol is none, the ids of its bytes."""
        if (i := self.ids.get(symbol)) is not None:
            return [i]
        return [self.bytes_[b] for b in symbol.encode()] if self.bytes_ else [self.unknown]

    def merge(self, word: str) -> list[str]:
        scores = self.scores
        left, right, text = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1], list(word)
        agenda = [(-scores[p], i, p) for i in range(len(word) - 1) if (p := word[i : i + 2]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = right[i] if text[i] else -1
            if j < 0 or text[i] + text[j] != piece:
                continue  # one of the two was merged before
            text[i], text[j] = piece, ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (p := piece + text[k]) in scores:
                    heapq.heappush(agenda, (-scores[p], i, p))
            h = left[i]
            if h >= 0 and (p := text[h] + piece) in scores:
                heapq.heappush(agenda, (-scores[p], h, p))
        return [s for s in text if s]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        at[self.pair_keys[at] != key] = len(self.pair_keys) - 1
        return self.pair_rank[at], self.pair_piece[at]

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids, as int32 bytes, of words that are not empty."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.of_char[np.minimum(points, len(self.of_char) - 1)]
        # other characters have numbers of their own and make no pairs
        sym = np.where(sym < 0, points + self.n_symbols, sym)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, piece = (np.r_[x, y] for x, y in zip(self._pairs(sym[:-1], sym[1:]), (np.int32(NONE), -1)))
        rank[:-1][word[1:] != word[:-1]] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.r_[head, len(word)])
            if (best == NONE).any():
                over = np.repeat(best == NONE, size)
                done.append((word[over], sym[over]))
                sym, word, rank, piece = (x[~over] for x in (sym, word, rank, piece))
                size, best = size[best != NONE], best[best != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # the leftmost of each word
            sym[hit] = piece[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # one symbol of each word before has gone
            sym, word, rank, piece = (x[keep] for x in (sym, word, rank, piece))
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                r, p = self._pairs(sym[i], sym[j])
                rank[i], piece[i] = np.where((j > i) & (word[i] == word[j]), r, NONE), p
        word, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        ids, at = self.symbol_ids, self.symbol_at
        if (other := sym >= self.n_symbols).any():
            new, sym[other] = np.unique(sym[other], return_inverse=True)
            more = [self.fallback(chr(x - self.n_symbols)) for x in new]
            sym[other] += self.n_symbols
            ids, at = np.r_[ids, np.array([i for x in more for i in x], np.int32)], np.r_[at, at[-1] + np.cumsum([len(x) for x in more])]
        size = at[sym + 1] - at[sym]
        end = np.cumsum(size)
        data = ids[np.repeat(at[sym] - end + size, size) + np.arange(end[-1])].tobytes()
        stop = [0, *(4 * end[np.flatnonzero(np.r_[word[1:] != word[:-1], True])]).tolist()]
        return [data[a:b] for a, b in zip(stop[:-1], stop[1:])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as int32 bytes."""
        young, old = self.young, self.old
        out = [young.get(w) or old.get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        short = [i for i in new if len(words[i]) <= LONG]
        for i, x in zip(short, self.merge_all([words[i] for i in short])):
            out[i] = x
        if len(short) < len(new):
            for i in new:
                if out[i] is None:
                    out[i] = array("i", [k for s in self.merge(words[i]) for k in self.fallback(s)]).tobytes()
        for w, x in zip(words, out):
            if len(w) <= LONG:
                young[w] = x
        if len(young) >= REMEMBERED:
            self.young, self.old = {}, young
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without NULL, and each text's first one (one entry more than texts)."""
        spaced = pc.replace_substring(texts.cast(pa.large_string()), " ", SPACE)
        if self.dummy:
            some = pc.not_equal(spaced, "")
            spaced = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), spaced, pa.scalar("", pa.large_string())), spaced)
        if isinstance(spaced, pa.ChunkedArray):
            spaced = spaced.combine_chunks()
        _, offs, data = spaced.buffers()
        offs = np.frombuffer(offs, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(spaced) + 1, np.int64)
        space = np.zeros(n, bool)
        mark = np.flatnonzero((raw[:-2] == _SPACE[0]) & (raw[1:-1] == _SPACE[1]) & (raw[2:] == _SPACE[2]))
        space[mark] = True
        start = np.zeros(n + 1, bool)
        start[mark] = True
        start[mark[mark >= 3][space[mark[mark >= 3] - 3]]] = False  # goes on with the spaces before
        alone = np.flatnonzero(self.alone[raw])
        start[alone] = start[alone + 1] = True
        start[offs] = True
        at = np.flatnonzero(start)  # ends with n
        words = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = words.dictionary_encode()
        each = self.encode_words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        base = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(each), np.int32)
        k = np.asarray(coded.indices)
        end = np.cumsum(size[k])
        ids = ids[np.repeat(base[k] - end + size[k], size[k]) + np.arange(end[-1])]
        return ids, np.r_[0, end][np.searchsorted(at, offs)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts whose ids begin at first (one entry more than texts)."""
        size = (self.raw_at[1:] - self.raw_at[:-1])[ids]
        at = np.r_[0, np.cumsum(size)]
        data = self.raw[np.repeat(self.raw_at[ids] - at[:-1], size) + np.arange(at[-1])]
        offs = at[first]
        if self.dummy:
            some = np.flatnonzero(np.diff(offs) > 0)
            lead = offs[some][data[offs[some]] == 32]
            keep = np.ones(len(data), bool)
            keep[lead] = False
            data, offs = data[keep], offs - np.searchsorted(lead, offs)
        return data, offs


_codecs: dict[str, Codec] = {}


def codec(proto: bytes) -> Codec:
    key = hashlib.sha1(proto).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(proto)
    return _codecs[key]


def _encode(proto: bytes, check: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto)
        for b in batches:
            for lo, hi, data, offs in T.chunks(b.column("text"), 4 << 20):
                part = b.slice(lo, hi - lo)
                texts = part.column("text")
                strings = [t or "" for t in texts.to_pylist()]
                ids, first = c.encode(pc.fill_null(texts, ""))
                back, at = c.decode(ids, first)
                raw = data.tobytes()
                back = back.tobytes()
                same = [back[at[i] : at[i + 1]] == raw[offs[i] : offs[i + 1]] for i in range(hi - lo)]
                own = ids.tobytes()
                agrees = [array("i", x).tobytes() == own[4 * first[i] : 4 * first[i + 1]] for i, x in enumerate(c.library.encode(strings, num_threads=1))] if check else [None] * (hi - lo)
                null = np.asarray(texts.is_null())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)),
                    "n_ids": pa.array(np.diff(first).astype(np.int32), mask=null),
                    "agrees": pa.array(np.array(agrees, object), pa.bool_(), mask=null),
                    "round_trip": pa.array(np.array(same, bool), mask=null),
                })

    return run


def encode(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """(doc_id, ids, n_ids, agrees, round_trip) for every row of docs.

    agrees: the sentencepiece library gives the same ids (NULL unless ``check``). round_trip: decoding gives the text back;
    not so for texts with U+2581, which stands for a space. A NULL text gives NULLs, an empty one no ids. Strings that name
    control pieces are ordinary text. Repeated rows give equal rows, an empty table none; other columns are not looked at.
    The model file is read by the driver and sent to the executors; one that is not of the merge type, normalises texts or
    has pieces of users is a ValueError.
    """
    with open(model, "rb") as f:
        proto = f.read()
    require_merge_type(proto)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(proto, check), f"doc_id {kind}, ids array<int>, n_ids int, agrees boolean, round_trip boolean")


def _decode(proto: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto)
        for b in batches:
            ids = b.column("ids")
            first = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))]
            data, offs = c.decode(np.asarray(ids.flatten(), np.int64), first)
            raw = data.tobytes()
            texts = [raw[offs[i] : offs[i + 1]].decode(errors="replace") if ok else None for i, ok in enumerate(ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); NULL ids give a NULL text, no ids an empty one, bytes that are no UTF-8 U+FFFD."""
    with open(model, "rb") as f:
        proto = f.read()
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(proto), f"doc_id {kind}, text string")
