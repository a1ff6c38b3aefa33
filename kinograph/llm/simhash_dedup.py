"""SimHash near-dedup by anchor-point covering.

A fingerprint is two independent 64-bit SimHashes of a text's distinct lower-cased words. Two texts are near-duplicates
if the first differ in at most ``distance`` bits and the second in at most ``confirm``.

Candidates come from anchors. The first SimHash is cut into blocks of 22, 21 and 21 bits; of 10 differing bits, at most
3, 3 and 2 lie in one of the three (else there were 4 + 4 + 3), so every pair is found. Over each block, the anchors are the
words of a covering code: the Hamming (15, 11) code on 15 bits, of covering radius 1, times all values of the others. A
fingerprint is at home at its nearest anchor and probes every anchor within the radius plus the block's threshold, so any two
within the threshold meet at the home of either, and are compared there.

A fingerprint probes 1,139 anchors. What is shuffled is not one row for each but one for each bin of anchors, those that
share a block's first bits; the anchors of a bin are looked up where its homes are.

Groups are the connected components of near-duplicates, found by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm import _text as T
from kinograph.llm._common import cut, partitions, text_key

DISTANCE, CONFIRM = 10, 12
#: First bit, bits and threshold of each block.
BLOCKS = ((0, 22, 3), (22, 21, 3), (43, 21, 2))
CODE_BITS, RADIUS = 15, 1
#: Bits of a block, its highest ones, that name the bin of an anchor.
BIN_BITS = 5


def _simhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in T.chunks(pc.utf8_lower(pc.fill_null(b.column("text"), "")), 1 << 20):
            starts, ends, first = T.words(data, offs)
            h = T.word_hashes(data, starts, ends)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
            h, doc = h[new], doc[new]
            if not len(h):
                continue
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            count = np.diff(np.r_[head, len(doc)])
            out = []
            for x in (h, T.mix(h + T.U(0x51ED270B))):
                ones = np.add.reduceat(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), head, axis=0, dtype=np.int32)
                out.append(np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.int64).ravel())
            rows = doc[head] + lo
            yield pa.RecordBatch.from_pydict({"absent": b.column("absent").take(rows), "doc_id": b.column("doc_id").take(rows), "th": b.column("th").take(rows), "fa": out[0], "fb": out[1]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(absent, doc_id, th, fa, fb) of every text with at least one word."""
    rows = docs.select(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("th"), "text").where("text IS NOT NULL")
    return rows.mapInArrow(_simhash, "absent boolean, doc_id bigint, th bigint, fa bigint, fb bigint")


def syndrome(v: int) -> int:
    return reduce(lambda x, y: x ^ y, (i + 1 for i in range(CODE_BITS) if v >> i & 1), 0)


def errors(bits: int, reach: int) -> list[list[int]]:
    """For each syndrome, all differences of weight up to reach that lead to a word of the code; the least comes first."""
    out: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for k in range(reach + 1):
        for c in combinations(range(bits), k):
            e = sum(1 << i for i in c)
            out[syndrome(e & ((1 << CODE_BITS) - 1))].append(e)
    # a nearest anchor changes nothing outside the code's bits, and at most one bit within
    return [sorted(x, key=lambda e: (e.bit_count(), e)) for x in out]


def _found(distance: int, confirm: int, blocks: tuple[tuple[int, int, int], ...], limit: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Near pairs from the homes and then the probes of each bin."""
    low = (1 << CODE_BITS) - 1
    syndromes = np.array([syndrome(v) for v in range(low + 1)])
    tables = {(bits, reach): [np.array(x, np.int64) for x in errors(bits - BIN_BITS, reach)] for _, bits, t in blocks for reach in range(RADIUS + t + 1)}
    nearest = np.array([x[0] for x in errors(CODE_BITS, RADIUS)])

    def local(fa: np.ndarray, begin: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        v = (fa.view(np.uint64) >> np.uint64(begin)).astype(np.int64) & ((1 << (bits - BIN_BITS)) - 1)
        return v, syndromes[v & low]

    def compare(u: tuple[np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        (fa, fb), (ha, hb) = u, v
        # either of two meets the other at its home: once is enough
        use = np.flatnonzero((np.bitwise_count((fa ^ ha).view(np.uint64)) <= distance) & ((fa < ha) | ((fa == ha) & (fb < hb))))
        fa, fb, ha, hb = fa[use], fb[use], ha[use], hb[use]
        use = np.bitwise_count((fb ^ hb).view(np.uint64)) <= confirm
        return fa[use], fb[use], ha[use], hb[use]

    def probe(at: int, homes: tuple[np.ndarray, ...], fa: np.ndarray, fb: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        begin, bits, threshold = blocks[at >> BIN_BITS]
        ha, hb, first = homes
        v, s = local(fa, begin, bits)
        top = (fa.view(np.uint64) >> np.uint64(begin + bits - BIN_BITS)).astype(np.int64) & ((1 << BIN_BITS) - 1)
        kind = (RADIUS + threshold - np.bitwise_count(top ^ (at & ((1 << BIN_BITS) - 1))).astype(np.int64)) * len(nearest) + s
        order = np.argsort(kind, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            reach, syn = divmod(int(kind[rows[0]]), len(nearest))
            e = tables[bits, reach][syn]
            step = max(1, (1 << 20) // max(1, len(e)))
            for k in range(0, len(rows), step):
                r = rows[k : k + step]
                anchors = (v[r][:, None] ^ e).ravel()
                count = first[anchors + 1] - first[anchors]
                hit = np.flatnonzero(count)
                r, lo, count = r[hit // max(1, len(e))], first[anchors[hit]], count[hit]
                total = np.cumsum(count)
                i = 0
                while i < len(r):
                    done = total[i - 1] if i else 0
                    j = max(i + 1, int(np.searchsorted(total, done + (1 << 21), "right")))
                    c = count[i:j]
                    h = np.arange(c.sum()) + np.repeat(lo[i:j] - (total[i:j] - c - done), c)
                    x = np.repeat(r[i:j], c)
                    yield compare((fa[x], fb[x]), (ha[h], hb[h]))
                    i = j

    def index(at: int, ha: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, ...]:
        begin, bits, _ = blocks[at >> BIN_BITS]
        v, s = local(ha, begin, bits)
        home = v ^ nearest[s]
        order = np.argsort(home, kind="stable")
        return ha[order], hb[order], np.r_[0, np.cumsum(np.bincount(home, minlength=1 << (bits - BIN_BITS)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, held, ready, n = None, [], [], None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, ready, n
            if held:
                fa, fb = (np.concatenate(x) for x in zip(*held))
                if ready is None:
                    none = np.zeros(0, np.int64)
                    ready = index(now[0], *((np.concatenate(x) for x in zip(*homes)) if homes else (none, none)))
                for part in probe(now[0], ready, fa, fb):
                    if len(part[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["fa", "fb", "ha", "hb"])
            held, n = [], 0

        for b in batches:
            at, salt, side, fa, fb = (np.asarray(b.column(c)) for c in ("at", "salt", "side", "fa", "fb"))
            ends = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(salt) != 0) | (np.diff(side) != 0)) + 1), len(at)]
            for i, j in zip(ends[:-1], ends[1:]):
                if i == j:
                    continue
                if now != (key := (int(at[i]), int(salt[i]))):
                    yield from flush()
                    now, homes, ready = key, [], None
                (held if side[i] else homes).append((fa[i:j], fb[i:j]))
                if side[i] and (n := n + j - i) >= limit:
                    yield from flush()
        yield from flush()

    return run


def near_pairs(prints: DataFrame, distance: int = DISTANCE, confirm: int = CONFIRM, blocks: tuple[tuple[int, int, int], ...] = BLOCKS) -> DataFrame:
    """(u, v), each a struct (fa, fb), u < v: distinct fingerprints that are near."""
    if sum(t + 1 for _, _, t in blocks) <= distance:
        raise ValueError(f"blocks {blocks} do not cover a distance of {distance}")
    # the probes of a bin are split where there are more partitions than bins; its homes are few
    salts = max(1, partitions(prints.sparkSession) // (len(blocks) << BIN_BITS))
    homes, probes = [], []
    for k, (begin, bits, threshold) in enumerate(blocks):
        top = F.shiftrightunsigned("fa", begin + bits - BIN_BITS).bitwiseAND((1 << BIN_BITS) - 1).cast("int")
        homes.append(top.bitwiseOR(F.lit(k << BIN_BITS)))
        probes += [top.bitwiseXOR(F.lit(k << BIN_BITS | e)) for e in range(1 << BIN_BITS) if e.bit_count() <= RADIUS + threshold]
    at_home = prints.select(F.explode(F.array(*homes)).alias("at"), "fa", "fb").select("at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), "fa", "fb")
    reached = prints.select(F.explode(F.array(*probes)).alias("at"), F.pmod(F.xxhash64("fb"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("side"), "fa", "fb")
    met = at_home.unionByName(reached).repartition("at", "salt").sortWithinPartitions("at", "salt", "side")
    found = met.mapInArrow(_found(distance, confirm, blocks), "fa bigint, fb bigint, ha bigint, hb bigint")
    return found.select(F.struct("fa", "fb").alias("u"), F.struct(F.col("ha").alias("fa"), F.col("hb").alias("fb")).alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is the least node of its component."""
    state = None
    edges = cut(edges.select("u", "v"))
    while True:
        both = edges.union(edges.select("v", "u"))
        large = both.selectExpr("u", "v", "least(u, min(v) OVER (PARTITION BY u)) AS m").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        down = large.selectExpr("greatest(u, v) AS u", "least(u, v) AS v")
        small = down.selectExpr("u", "v", "min(v) OVER (PARTITION BY u) AS m")
        edges = cut(small.selectExpr("explode(array(named_struct('u', v, 'v', m), named_struct('u', u, 'v', m))) AS e").select("e.*").where("u <> v").distinct())
        now = edges.selectExpr("count(*)", "sum(cast(xxhash64(u, v) AS decimal(38, 0)))").first()
        if now == state:
            return edges.selectExpr("u AS node", "v AS root").union(edges.selectExpr("v AS node", "v AS root").distinct())
        state = now


def groups(docs: DataFrame, distance: int = DISTANCE, confirm: int = CONFIRM) -> DataFrame:
    """(absent, doc_id, th, kept): every document that is not the kept one of its group; kept is a struct (absent, doc_id, th)."""
    prints = cut(fingerprints(docs))
    distinct = prints.groupBy("fa", "fb").agg(F.min(F.struct("absent", "doc_id", "th")).alias("least"), F.max(F.struct("absent", "doc_id", "th")).alias("most"))
    distinct = cut(distinct.select(F.struct("fa", "fb").alias("node"), "least", (F.col("least") != F.col("most")).alias("many")))
    roots = components(near_pairs(distinct.select("node.fa", "node.fb"), distance, confirm))
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("kept"), F.count("*").alias("nodes"), F.max("many").alias("many")).where("many OR nodes > 1")
    # back by join: the nodes of a group never meet in one row
    kept = rooted.join(kept.select("root", "kept"), "root").select("kept", "node.fa", "node.fb")
    return prints.join(kept, ["fa", "fb"]).where("struct(absent, doc_id, th) <> kept").select("absent", "doc_id", "th", "kept")


def near_copies(docs: DataFrame, distance: int = DISTANCE, confirm: int = CONFIRM) -> DataFrame:
    """(doc_id, kept_doc_id): one row for every document that another of its group stands for.

    The kept document of a group is the least in the order of doc_id (NULL last), then of the text's hash. Texts without
    words (NULL, empty, blank) belong to no group. Rows equal in doc_id and text are one document: all are kept, or each
    gives a row. An empty table gives no rows; other columns are not looked at.
    """
    return groups(docs, distance, confirm).select("doc_id", F.col("kept.doc_id").alias("kept_doc_id"))


def simhash_dedup(docs: DataFrame, distance: int = DISTANCE, confirm: int = CONFIRM) -> DataFrame:
    """docs, with all its columns, without the documents that near_copies lists; texts without words stay."""
    names = docs.columns
    lowered = [c.lower() for c in names]
    left = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = f"c{lowered.index('doc_id')}", f"c{lowered.index('text')}"
    ids = docs.select(docs[names[lowered.index("doc_id")]].alias("doc_id"), docs[names[lowered.index("text")]].alias("text"))
    gone = groups(ids, distance, confirm).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    out = left.join(gone, F.col(doc).cast("bigint").eqNullSafe(F.col("gone_id")) & (text_key(F.col(text)) == F.col("gone_th")), "left_anti")
    return out.toDF(*names)
