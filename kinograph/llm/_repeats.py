"""Word windows that repeat anywhere in a corpus, found exactly; what the two substring dedups share.

A *window* is ``width`` consecutive words of one document. A caller gives every window an *anchor* that depends on the
window's words alone, so equal windows have equal anchors at equal distances. Consecutive windows with one anchor form a
*segment*. Hashes only propose; what is called a repeat was compared as bytes:

* In a chunk of texts, segments with one anchor and one content are compared where they are, and only the first goes on. If
  an anchor of a chunk has several contents, its segments are *open* from the start and go past the shuffle by anchor, but
  for one witness. So what meets at an anchor is a row or two for each chunk, however often a passage occurs.
* One shuffle by anchor tells which anchors have one content everywhere: their segments are *closed*, repeats as wholes of
  the first one. Others are open.
* The words of open and closed segments are sent to their anchors (many closed ones in groups, each with the words of the
  first). Closed segments are compared with the first one; windows of open ones with each other, as the caller does it.
* Anchors with too many open segments for one task, and those where equal hashes had different words, are worked off window by
  window, by an aggregation over the windows' words.

Order of occurrences: NULL doc_ids last, then doc_id, then the hash of the text (for repeated doc_ids), then position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm import _text as T
from kinograph.llm._common import SPACES, cut, text_key

#: From word hashes and each text's first word: for every window start, an id of its anchor's place, the anchor's place and its key.
Anchors = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: From word hashes, first words of windows, buckets in which equal windows meet and width: the windows in an order in which those of
#: equal hashes are neighbours, and for each whether its hash is that of the one before.
Groups = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
#: From bytes, starts and ends of words: a hash for each.
Hashes = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

KEY = "absent boolean, doc_id bigint, th bigint"
SEGMENT = f"{KEY}, start int, windows int, anchor bigint, place int, content bigint, state int"
RUN = f"{KEY}, start int, windows int, again boolean"
WORK = f"{KEY}, start int, windows int, anchor bigint, place int, copied boolean, closed boolean, group int, words binary"
#: States: closed so far; closed, with a later copy in the same chunk; a later copy, compared; open; a witness that an anchor is open.
CLOSED, COPIED, AGAIN, OPEN, OPEN_COPIED, WITNESS = range(6)
#: Open segments of an anchor that one task may get, and closed ones in a group.
HOT, GROUP = 1 << 16, 1 << 12
#: Bytes of text in which copies are found on the spot.
CHUNK = 4 << 20


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = b.column("doc_id")
    return np.asarray(ids.is_null()), np.asarray(ids.fill_null(0)), np.asarray(b.column("th").fill_null(0))


def _out(absent: np.ndarray, ids: np.ndarray, th: np.ndarray, **rest: np.ndarray) -> pa.RecordBatch:
    arrays = {"absent": pa.array(absent), "doc_id": pa.array(ids, mask=absent), "th": pa.array(th)}
    return pa.RecordBatch.from_pydict(arrays | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in rest.items()})


def _binary(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The bytes from first to last of each."""
    size = last - first
    end = np.cumsum(size)
    flat = data[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, end].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _ranks(absent: np.ndarray, ids: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The place of each document in the order of occurrences; rows of one document have one."""
    rank = np.empty(len(ids), np.int64)
    if len(ids):
        order = np.lexsort((th, ids, absent))
        rank[order] = np.cumsum(np.r_[False, (np.diff(absent[order]) != 0) | (np.diff(ids[order]) != 0) | (np.diff(th[order]) != 0)])
    return rank


def windows_of(first: np.ndarray, width: int) -> np.ndarray:
    """All window starts that lie within one text."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.cumsum(count) - count
    return np.repeat(first[:-1] - begin, count) + np.arange(count.sum())


def _segments(width: int, anchors: Anchors, hashes: Hashes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            absent, ids, th = _ids(b)
            for lo, hi, data, offs in T.chunks(b.column("text"), CHUNK):
                starts, ends, first = T.words(data, offs)
                w = windows_of(first, width)
                if not len(w):
                    continue
                h = hashes(data, starts, ends)
                at, place, key = (x[w] for x in anchors(h, first, width))
                new = np.flatnonzero(np.r_[True, (np.diff(w) != 1) | (np.diff(at) != 0)])
                n = np.diff(np.r_[new, len(w)])
                w0 = w[new]
                content = T.mix(T.range_hash(T.prefix_hash(h), w0, w0 + n + width - 1) + n.astype(np.uint64))
                # of several texts that begin at the same word, all but the last are empty
                doc = np.searchsorted(first, w0, "right") - 1
                anchor = T.mix(key[new])
                rank = _ranks(absent[lo:hi], ids[lo:hi], th[lo:hi])[doc]
                start = w0 - first[doc]
                order = np.lexsort((start, rank, content, anchor))
                a, c = anchor[order], content[order]
                head = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
                lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
                keep = np.ones(len(order), bool)
                keep[order[~head & (rank[order] == rank[lead]) & (start[order] == start[lead])]] = False  # the same document once more
                state = np.full(len(order), CLOSED, np.int32)
                # equal hashes: later copies are compared with the first
                plain, begin = T.plain_words(data, starts, ends)
                x, y = order[~head], lead[~head]
                stop = lambda i: begin[w0[i] + n[i] + width - 1]
                same = T.same_bytes(plain, begin[w0[x]], stop(x), begin[w0[y]], stop(y)) & (n[x] == n[y])
                clash, x, y = x[~same & keep[x]], x[same & keep[x]], y[same & keep[x]]
                state[x] = AGAIN
                state[y] = COPIED
                # anchors with several contents in this chunk
                several = np.zeros(len(order), bool)
                change = np.flatnonzero((a[1:] == a[:-1]) & (c[1:] != c[:-1]))
                several[change] = True
                several[np.searchsorted(a, anchor[clash])] = True
                group = np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
                open_ = np.zeros(len(order), bool)
                open_[order] = np.isin(group, np.unique(group[several]))
                mine = open_ & (state != AGAIN)
                state[mine] = np.where(state[mine] == COPIED, OPEN_COPIED, OPEN)
                # what needs no comparison at its anchor goes to a partition of its own choice; open segments keep the anchor as content
                spread = T.mix(anchor + (doc + lo).astype(np.uint64) * np.uint64(0x9E3779B9) + start.astype(np.uint64) + np.uint64(1))
                content = np.where(mine, anchor, content)
                seen = np.unique(anchor[mine])
                anchor = np.where(mine | (state == AGAIN), spread, anchor)
                row = (doc + lo)[keep]
                rest = {"start": start, "windows": n, "anchor": T.signed(anchor), "place": place[new] - w0, "content": T.signed(content), "state": state}
                yield _out(absent[row], ids[row], th[row], **{k: v[keep] if k in ("anchor", "content") else v[keep].astype(np.int32) for k, v in rest.items()})
                if len(seen):
                    none = np.zeros(len(seen), np.int64)
                    small = none.astype(np.int32)
                    yield _out(none > 0, none, none, start=small, windows=small, anchor=T.signed(seen), place=small, content=none, state=small + np.int32(WITNESS))

    return run


def _opened(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of segments; of first ones with many later ones, once for each group of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            absent, ids, th = _ids(b)
            want = b.column("segments")
            for lo, hi, data, offs in T.chunks(b.column("text"), 4 << 20):
                starts, ends, first = T.words(data, offs)
                plain, begin = T.plain_words(data, starts, ends)
                part = want.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths().fill_null(0)))
                start, n, anchor, place, copied, closed, group, copies = (np.asarray(x) for x in part.flatten().flatten())
                k = np.repeat(np.arange(len(doc)), copies)
                group = group[k] + np.arange(len(k)) - np.repeat(np.cumsum(copies) - copies, copies)
                doc, start, n, anchor, place, copied, closed = (x[k] for x in (doc, start, n, anchor, place, copied, closed))
                w0 = first[doc] + start
                words = _binary(plain, begin[w0], begin[w0 + n + width - 1])
                row = doc + lo
                yield _out(absent[row], ids[row], th[row], start=start, windows=n, anchor=anchor, place=place, copied=copied, closed=closed, group=group.astype(np.int32), words=words)

    return run


def numbered(order: np.ndarray, alike: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], words_of: Callable[[int], bytes]) -> np.ndarray:
    """A group number for each window: neighbours that hashes call alike are compared; runs in which some differ are grouped by their words."""
    equal = np.zeros(len(order), bool)
    i = np.flatnonzero(alike)
    equal[i] = same(order[i - 1], order[i])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~equal) - 1
    if (wrong := alike & ~equal).any():
        run = np.cumsum(~alike) - 1
        free = len(order)
        for r in np.unique(run[wrong]):
            found: dict[bytes, int] = {}
            for k in order[np.searchsorted(run, r) : np.searchsorted(run, r, "right")]:
                out[k] = found.setdefault(words_of(k), free + len(found))
            free += len(found)
    return out


def _compare(width: int, groups: Groups, hashes: Hashes, limit: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of windows that repeat, from segments sorted by anchor and group; clash: words differ where hashes are equal."""

    def closed_runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        absent, ids, th = _ids(b)
        anchor, group, start, n = (np.asarray(b.column(c)) for c in ("anchor", "group", "start", "windows"))
        copied = np.asarray(b.column("copied"))
        data, at = _joined(b)
        rank = _ranks(absent, ids, th)
        order = np.lexsort((start, rank, group, anchor))
        head = np.r_[True, (np.diff(anchor[order]) != 0) | (np.diff(group[order]) != 0)]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        same = T.same_bytes(data, at[order], at[order + 1], at[lead], at[lead + 1]) & (n[order] == n[lead])
        # the first one is in every group, but is one run
        again = ~((rank[order] == rank[lead]) & (start[order] == start[lead]))
        use = again | (head & (group[order] == 0)) & (copied[order] | np.r_[~head[1:], False])
        yield _out(absent[order][use], ids[order][use], th[order][use], start=start[order][use], windows=n[order][use], again=again[use], anchor=anchor[order][use], clash=~same[use])

    def open_runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        absent, ids, th = _ids(b)
        start, n, place, anchor, copied = (np.asarray(b.column(c)) for c in ("start", "windows", "place", "anchor", "copied"))
        n = n.astype(np.int64)
        data, _ = _joined(b)
        ends = np.flatnonzero(data == 32)
        begin = np.r_[0, ends + 1]
        tokens = hashes(data, begin[:-1], ends)
        size = n + width - 1
        base = np.cumsum(size) - size
        cum = np.cumsum(n) - n
        seg = np.repeat(np.arange(len(n)), n)
        off = np.arange(n.sum()) - cum[seg]
        # windows are equal only where anchors and the distances to them are
        bucket = np.lexsort((place[seg] - off, anchor[seg]))
        d, a = (place[seg] - off)[bucket], anchor[seg][bucket]
        number = np.empty(len(seg), np.int64)
        number[bucket] = np.cumsum(np.r_[True, (np.diff(d) != 0) | (np.diff(a) != 0)]) - 1
        first = base[seg] + off
        order, alike = groups(tokens, first, number, width)
        range_of = lambda i: (begin[first[i]], begin[first[i] + width])
        group = numbered(order, alike, lambda x, y: T.same_bytes(data, *range_of(x), *range_of(y)), lambda i: data[slice(*range_of(i))].tobytes())
        rank = _ranks(absent, ids, th)
        at = start[seg] + off
        order = np.lexsort((at, rank[seg], group))
        g, r, p = group[order], rank[seg][order], at[order]
        head = np.r_[True, g[1:] != g[:-1]]
        lead = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
        again = (r != r[lead]) | (p != p[lead])
        many = np.zeros(len(g), bool)
        many[lead[again]] = True
        state = np.zeros(len(g), np.int8)
        state[order] = np.where(again, 2, (many[lead] | copied[seg[order]]).astype(np.int8))
        cutpoint = np.flatnonzero(np.r_[True, (np.diff(seg) != 0) | (np.diff(state) != 0)])
        length = np.diff(np.r_[cutpoint, len(seg)])
        use = state[cutpoint] > 0
        cutpoint, length = cutpoint[use], length[use]
        s = seg[cutpoint]
        yield _out(absent[s], ids[s], th[s], start=at[cutpoint].astype(np.int32), windows=length.astype(np.int32), again=state[cutpoint] == 2, anchor=anchor[s], clash=np.zeros(len(s), bool))

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        closed = np.asarray(t.column("closed"))
        for mask, f in ((closed, closed_runs), (~closed, open_runs)):
            if mask.any():
                yield from f(t.filter(pa.array(mask)).combine_chunks().to_batches()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("words").nbytes
            if size < limit:
                continue
            t = pa.Table.from_batches(held)
            anchor, group = np.asarray(t.column("anchor")), np.asarray(t.column("group"))
            other = np.flatnonzero((anchor != anchor[-1]) | (group != group[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from work(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
            size = sum(x.column("words").nbytes for x in held)
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows, one after the other, and where each row's begin (one entry more than rows)."""
    words = b.column("words")
    size = np.fromiter(map(len, rows := words.to_pylist()), np.int64, len(words))
    return np.frombuffer(b"".join(rows), np.uint8), np.r_[0, np.cumsum(size)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("th"), "text").where("text IS NOT NULL")


def _with_words(docs: DataFrame, kept: DataFrame, width: int) -> DataFrame:
    fields = ["start", "windows", "anchor", "place", "copied", "closed", "group", "copies"]
    per = kept.groupBy("doc_id", "th").agg(F.collect_set(F.struct(*fields)).alias("segments"))
    joined = _texts(docs).join(per.withColumnsRenamed({"doc_id": "d", "th": "t"}), F.expr("doc_id <=> d AND th = t")).select("doc_id", "th", "text", "segments")
    return joined.withColumn("absent", F.col("doc_id").isNull()).mapInArrow(_opened(width), WORK)


def _windows(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of each window of open segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            absent, ids, th = _ids(b)
            start, n = np.asarray(b.column("start")), np.asarray(b.column("windows")).astype(np.int64)
            data, at = _joined(b)
            begin = np.r_[0, np.flatnonzero(data == 32) + 1]
            cum = np.cumsum(n) - n
            seg = np.repeat(np.arange(len(n)), n)
            off = np.arange(n.sum()) - cum[seg]
            first = np.searchsorted(begin, at[:-1])[seg] + off
            for k in range(0, len(seg), 1 << 13):
                s, w = seg[k : k + (1 << 13)], first[k : k + (1 << 13)]
                yield _out(absent[s], ids[s], th[s], start=(start[s] + off[k : k + (1 << 13)]).astype(np.int32), copied=np.asarray(b.column("copied"))[s], words=_binary(data, begin[w], begin[w + width]))

    return run


def _by_window(work: DataFrame, width: int) -> DataFrame:
    """Runs of one window each, from the segments' words: equal windows are grouped by their words, whatever their number."""
    each = work.mapInArrow(_windows(width), f"{KEY}, start int, copied boolean, words binary").withColumn("at", F.struct("absent", "doc_id", "th", "start"))
    key = [F.xxhash64("words").alias("key"), "words"]
    found = each.groupBy(*key).agg(F.min("at").alias("least"), F.max("at").alias("most"), F.max("copied").alias("copies")).where("least <> most OR copies")
    both = each.select("*", key[0]).join(found, ["key", "words"])
    return both.where("at <> least OR copies OR least <> most").selectExpr("absent", "doc_id", "th", "start", "1 AS windows", "at <> least AS again").distinct()


def repeated_runs(docs: DataFrame, width: int, anchors: Anchors, groups: Groups, hashes: Hashes = T.word_hashes, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """Runs of consecutive windows that occur more than once: again is false at the first occurrence, true at all others."""
    rows = _texts(docs).withColumn("absent", F.col("doc_id").isNull())
    found = rows.mapInArrow(_segments(width, anchors, hashes), SEGMENT).repartition("anchor").withColumn("at", F.struct("absent", "doc_id", "th", "start"))
    marked = found.selectExpr(
        "*",
        "min(at) OVER (PARTITION BY anchor, content) AS least",
        "max(at) OVER (PARTITION BY anchor, content) AS most",
        "max(state) OVER (PARTITION BY anchor, content) AS top",
        "count(*) OVER (PARTITION BY anchor, content) AS n",
        f"min(content) OVER (PARTITION BY anchor) <> max(content) OVER (PARTITION BY anchor) OR max(state) OVER (PARTITION BY anchor) = {WITNESS} AS differ",
    ).withColumn("repeats", F.expr(f"least <> most OR top = {COPIED}"))
    local = f"state IN ({AGAIN}, {OPEN}, {OPEN_COPIED})"
    size = f"CASE WHEN {local} OR differ OR n <= {group} THEN 1 ELSE cast(ceil(n / {group}) AS int) END"
    kept = cut(
        marked.where(f"state <> {WITNESS} AND ({local} OR repeats OR differ)").withColumn("groups", F.expr(size)).selectExpr(
            "absent", "doc_id", "th", "start", "windows", "place",
            f"CASE WHEN state IN ({OPEN}, {OPEN_COPIED}) THEN content ELSE anchor END AS anchor",
            f"state IN ({COPIED}, {OPEN_COPIED}) AS copied",
            f"NOT (differ OR state IN ({OPEN}, {OPEN_COPIED})) AS closed",
            f"state = {AGAIN} AS again",
            "CASE WHEN groups = 1 OR at = least THEN 0 ELSE cast(pmod(xxhash64(at), groups) AS int) END AS group",
            "CASE WHEN at = least THEN groups ELSE 1 END AS copies",
            # a first one that is alone in this chunk and everywhere needs no comparison
            f"state IN ({COPIED}) AND least = most AND NOT differ AS alone",
        )
    )
    done = kept.where("again OR alone").selectExpr("absent", "doc_id", "th", "start", "windows", "again")
    rest = kept.where("NOT again AND NOT alone")
    crowded = cut(rest.where("NOT closed").groupBy("anchor").count().where(F.col("count") > hot).select("anchor"))
    few = rest.join(crowded, "anchor", "left_anti") if (many := not crowded.isEmpty()) else rest
    work = _with_words(docs, few, width).repartition("anchor", "group").sortWithinPartitions("anchor", "group")
    compared = cut(work.mapInArrow(_compare(width, groups, hashes), f"{RUN}, anchor bigint, clash boolean"))
    clash = compared.where("clash").select("anchor").distinct()
    if clashes := not clash.isEmpty():
        compared = compared.join(clash, "anchor", "left_anti")
    done = done.unionByName(compared.select(done.columns))
    if many or clashes:
        again = rest.join(crowded.union(clash).distinct(), "anchor", "left_semi").withColumns({"group": F.lit(0), "copies": F.lit(1)})
        done = done.unionByName(_by_window(_with_words(docs, again, width), width))
    return done


def _merged(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            absent, ids, th = _ids(b)
            again = np.asarray(b.column("again"))
            runs = b.column("runs")
            doc = np.repeat(np.arange(b.num_rows), np.asarray(runs.value_lengths()))
            s, n = (np.asarray(x).astype(np.int64) for x in runs.flatten().flatten())
            order = np.lexsort((s, doc))
            doc, s, e = doc[order], s[order], s[order] + n[order] + width - 1
            # the end so far, within a document: documents are set apart by a distance that no position reaches
            far = doc * (1 << 40)
            reach = np.maximum.accumulate(e + far)
            head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] + far[1:] > reach[:-1])])
            last = np.r_[head[1:], len(doc)] - 1
            r = doc[head]
            yield _out(absent[r], ids[r], th[r], first_word=s[head].astype(np.int32), end_word=(reach[last] - far[last]).astype(np.int32), again=again[r])

    return run


def repeated_spans(runs: DataFrame, width: int) -> DataFrame:
    """(absent, doc_id, th, first_word, end_word, again): the longest spans of words that windows of one kind cover."""
    by = runs.groupBy("absent", "doc_id", "th", "again").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return by.mapInArrow(_merged(width), f"{KEY}, first_word int, end_word int, again boolean")


def _cut_out(text_at: int, n_chars_at: int | None, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(text_at), b.column(b.num_columns - 1)
            hit = np.flatnonzero(np.asarray(spans.is_valid()))
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            keep = np.ones(b.num_rows, bool)
            if len(hit):
                new = texts.to_pylist()
                chars = columns[n_chars_at].to_pylist() if n_chars_at is not None else None
                for i in hit:
                    raw = new[i].encode()
                    data = np.frombuffer(raw, np.uint8)
                    starts = np.r_[T.words(data, np.array([0, len(data)]))[0], len(data)]
                    at, out = 0, []
                    for x in sorted((s["first_word"], s["end_word"]) for s in spans[i].as_py()):
                        out.append(raw[at : starts[x[0]]])
                        at = starts[x[1]]
                    new[i] = (b"".join(out) + raw[at:]).decode()
                    keep[i] = bool(new[i].strip(SPACES))
                    if chars is not None:
                        chars[i] = len(new[i])
                columns[text_at] = pa.array(new, texts.type)
                if chars is not None:
                    columns[n_chars_at] = pa.array(chars, columns[n_chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return run


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the words of spans that occur earlier; a document of which nothing is left goes. n_chars follows the text."""
    names = docs.columns
    lowered = [c.lower() for c in names]
    per = spans.where("again").groupBy("doc_id", "th").agg(F.collect_list(F.struct("first_word", "end_word")).alias("s"))
    left = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, doc = f"c{lowered.index('text')}", f"c{lowered.index('doc_id')}"
    joined = left.join(per, (F.col(doc).cast("bigint").eqNullSafe(F.col("doc_id"))) & (text_key(F.col(text)) == F.col("th")), "left").select(*left.columns, "s")
    out = joined.mapInArrow(_cut_out(lowered.index("text"), lowered.index("n_chars") if "n_chars" in lowered else None, left.columns), left.schema)
    return out.toDF(*names)


def sql(width: int) -> str:
    """DuckDB SQL for the spans of documents whose doc_ids are unique."""
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {width - 1})) AS i FROM w WHERE len(ws) >= {width}),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {width}], ' ')) AS m FROM p),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1 AS again, count(*) OVER (PARTITION BY m) AS c FROM k),
g AS (SELECT *, lag(i) OVER (PARTITION BY doc_id, again ORDER BY i) AS before FROM n WHERE c > 1),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + {width} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, again ORDER BY i) AS span FROM g)
SELECT doc_id, min(i)::INTEGER AS first_word, (max(i) + {width})::INTEGER AS end_word, again FROM s GROUP BY doc_id, again, span
"""
