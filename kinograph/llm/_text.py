"""NumPy over whole Arrow string columns: words, hashes of byte and token ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinograph.llm._common import SPACES

U = np.uint64
_WORDS = np.zeros(256, bool)
_WORDS[[ord(c) for c in SPACES]] = True
IS_SPACE = _WORDS
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=U) * _BASE)


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        x = np.full(size, base, U)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if size <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the ranges lo to hi, the same wherever the range lies."""
    return (h[hi] - h[lo]) * _power(_INVERSE, len(h))[lo]


def chunks(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with about limit bytes; one text is never split. NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (one entry more than texts)."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of what its bytes and their places in the word are mixed to, mixed with its length."""
    n = ends - starts
    cum = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(cum, n)
    byte = data[place + np.repeat(starts, n)]
    with np.errstate(over="ignore"):
        x = (BYTE_HASH[byte] ^ _place_hash(place)) * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(29)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(32)
    sums = np.add.reduceat(x, cum) if len(n) else np.zeros(0, U)
    return mix(sums + n.astype(U))


_PLACES = mix((np.arange(1, 1025, dtype=U) << U(9)) * _BASE)


def _place_hash(place: np.ndarray) -> np.ndarray:
    if not len(place) or place.max() < len(_PLACES):
        return _PLACES[place]
    return mix((place.astype(U) + U(1) << U(9)) * _BASE)


def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and the start of each (one entry more than words)."""
    size = ends - starts + 1
    at = np.r_[0, np.cumsum(size)]
    out = data[np.minimum(np.repeat(starts - at[:-1], size) + np.arange(at[-1]), max(0, len(data) - 1))] if len(size) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 32
    return out, at


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, limit: int = 1 << 22) -> np.ndarray:
    """Whether the bytes from a to a_end are those from b to b_end, for each of many pairs of ranges."""
    out = a_end - a == b_end - b
    rows = np.flatnonzero(out & (a != b))
    size = (a_end - a)[rows]
    end = np.cumsum(size)
    lo = 0
    while lo < len(rows):
        done = end[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, done + limit, "right")))
        r, n = rows[lo:hi], size[lo:hi]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        differ = data[np.repeat(a[r], n) + step] != data[np.repeat(b[r], n) + step]
        bad = np.repeat(np.arange(len(r)), n)[differ]
        out[r[bad]] = False
        lo = hi
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
