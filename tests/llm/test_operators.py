import hashlib
import os
import random
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F

from kinograph.llm import _repeats, _text, exact_dedup, fingerprints, language_id, line_dedup, packing, recompression, sentencepiece_codec, sharding, simhash_dedup, suffix_dedup

SF = "/root/testdata"


def rows(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def table(spark, docs):
    return spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def messy(spark):
    return cases.messy(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.mark.parametrize("find", [recompression.substring_repeats, suffix_dedup.suffix_repeats])
def test_repeats_as_brute_force(spark, find):
    docs = cases.passages()
    assert rows(find(table(spark, docs))) == Counter(cases.spans(docs, 50))


@pytest.mark.parametrize(("find", "drop"), [(recompression.substring_repeats, recompression.substring_dedup), (suffix_dedup.suffix_repeats, suffix_dedup.suffix_dedup)])
def test_repeats_of_awkward_rows(find, drop, messy, empty):
    n = len(cases.words(cases.LONG))
    assert rows(find(messy)) == Counter({(6, 0, n, False): 1, (7, 0, n, True): 1})
    assert rows(drop(messy).select("doc_id", "text")) == rows(messy.where("doc_id IS NULL OR doc_id <> 7").select("doc_id", "text"))
    assert drop(messy).columns == messy.columns
    assert find(empty).count() == drop(empty).count() == 0


def test_repeats_are_cut_as_brute_force(spark):
    docs = cases.passages(2)
    assert rows(suffix_dedup.suffix_dedup(table(spark, docs))) == Counter(cases.cut_repeats(docs, 50).items())
    assert rows(recompression.substring_dedup(table(spark, docs))) == Counter(cases.cut_repeats(docs, 50).items())


FINDERS = [(recompression.interior_anchors(6), recompression.groups), (suffix_dedup.minimizers(12), suffix_dedup.groups)]


@pytest.mark.parametrize(("anchors", "groups"), FINDERS)
@pytest.mark.parametrize(("poor", "hot", "group"), [(True, 1 << 16, 1 << 12), (True, 40, 2), (False, 3, 2)])
def test_repeats_do_not_rest_on_hashes(spark, anchors, groups, poor, hot, group):
    hashes = (lambda data, starts, ends: data[starts].astype("uint64") % 3) if poor else _text.word_hashes
    docs = cases.passages(4, 24)
    runs = _repeats.repeated_runs(table(spark, docs).repartition(4, "doc_id"), 50, anchors, groups, hashes, hot, group)
    assert rows(_repeats.repeated_spans(runs, 50).select("doc_id", "first_word", "end_word", "again")) == Counter(cases.spans(docs, 50))


def test_words_of_equal_polynomial_hashes(spark):
    """Modulo 2**64, a Thue-Morse word and its complement have one polynomial hash for every base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    rest = [f"w{i}" for i in range(49)]
    docs = {1: " ".join([*rest[:20], a, *rest[20:]]), 2: " ".join([*rest[:20], b, *rest[20:]])}
    for find, drop in ((recompression.substring_repeats, recompression.substring_dedup), (suffix_dedup.suffix_repeats, suffix_dedup.suffix_dedup)):
        for parts in (1, 2):
            assert find(table(spark, docs).repartition(parts)).count() == 0
            assert rows(drop(table(spark, docs).repartition(parts))) == Counter(docs.items())


def test_exact_dedup(messy, empty, spark):
    assert rows(exact_dedup.exact_dedup(messy)) == Counter({(1, 1): 1, (2, 1): 1, (None, 1): 1, (7, 6): 1})
    assert exact_dedup.exact_dedup(empty).count() == 0
    r = random.Random(3)
    docs = {i: r.choice("abc") * r.randrange(3) for i in range(300)}
    first = {}
    want = Counter((d, first[t]) for d, t in docs.items() if first.setdefault(t, d) != d)
    assert rows(exact_dedup.exact_dedup(table(spark, docs).repartition(7), 4)) == want
    assert exact_dedup.drop_exact_copies(table(spark, docs)).count() == len(first)
    left = exact_dedup.drop_exact_copies(messy)
    assert left.columns == messy.columns and rows(left.select("doc_id", "text")) == Counter([(1, "alpha beta"), (3, None), (4, ""), (5, " \n\t "), (6, cases.LONG), (8, "Ünïcödé ▁ 日本\n\nnoch <s> mehr\x00?")])
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    absent = spark.createDataFrame([(None, "x"), (None, "x"), (1, None), (1, None)], "doc_id bigint, text string")
    assert rows(exact_dedup.drop_exact_copies(absent)) == Counter({(None, "x"): 1, (1, None): 2})


def test_exact_dedup_of_a_hot_text(spark):
    """Any row that gathers the ids of a text would be as long as the text has copies."""
    docs = spark.range(30_000).selectExpr("CASE WHEN id < 20000 THEN id WHEN id < 25000 THEN 7 END AS doc_id", "'' AS text")
    found = exact_dedup.exact_dedup(docs, 8)
    got = rows(found)
    assert got[None, 0] == 5000 and got[7, 0] == 5001 and got[0, 0] == 0 and sum(got.values()) == 29_999
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(id" not in plan and "flatten" not in plan


def test_fingerprints(messy, empty, spark):
    found = {r.doc_id: r for r in fingerprints.sketches(messy).where("doc_id IS NOT NULL").collect()}
    assert [found[i].n_shingles for i in (1, 3, 4, 5, 6)] == [1, 0, 0, 0, 29_996]
    assert found[3].sketch == found[4].sketch == [] and found[6].sketch == found[7].sketch
    assert fingerprints.sketches(messy).count() == 10 and fingerprints.sketches(empty).count() == 0
    part = " ".join(cases.words(cases.LONG)[:9000])
    s = fingerprints.sketches(table(spark, {1: cases.LONG, 2: part}))
    a, b = (s.where(f"doc_id = {i}").selectExpr(f"sketch AS s{i}") for i in (1, 2))
    small, large = b.crossJoin(a).select(fingerprints.containment(b.s2, a.s1), fingerprints.containment(a.s1, b.s2)).first()
    assert small == 1.0 and abs(large - 0.3) < 0.05
    assert len(fingerprints.merge(s.selectExpr("1 AS k", "*"), "k").first().sketch) == len(found[6].sketch)


def test_merged_sketches_and_containment_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/sf0.001/documents.parquet").where("text IS NOT NULL")
    made = fingerprints.sketches(docs, 3, 4).join(docs.select("doc_id", "source"), "doc_id")
    merged = {r.source: r for r in fingerprints.merge(made, "source").collect()}
    shingles, sizes = {}, Counter()
    for r in docs.collect():
        w = cases.words(r.text.lower())
        mine = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        shingles.setdefault(r.source, set()).update(mine)
        sizes[r.source] += len(mine)
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    assert {k: (r.n_shingles, r.sketch) for k, r in merged.items()} == {k: (sizes[k], sorted(h for h in map(number, v) if h < 1 << 58)) for k, v in shingles.items()}
    # a few documents against the sketches of whole sources
    pairs = made.alias("a").join(spark.createDataFrame([(k, r.sketch) for k, r in merged.items()], "k string, s array<bigint>"), F.expr("size(a.sketch) > 40"))
    checked = 0
    for r in pairs.select("doc_id", "k", fingerprints.containment(F.col("a.sketch"), F.col("s")).alias("c")).collect():
        text = docs.where(F.col("doc_id") == r.doc_id).first().text if checked < 20 else None
        if text is not None:
            w = cases.words(text.lower())
            mine = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
            assert abs(r.c - len(mine & shingles[r.k]) / len(mine)) < 0.3
            checked += 1
    assert checked == 20


def test_sentencepiece(messy, empty, spark):
    got = sentencepiece_codec.encode(messy).collect()
    assert len(got) == 10 and all(r.agrees in (True, None) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].ids is None and by[4].ids == [] and by[6].round_trip and not by[8].round_trip  # 8 has U+2581
    assert sentencepiece_codec.encode(empty).count() == 0
    r = random.Random(5)
    docs = {i: "".join(r.choice(["the ", "a", "é", "  ", "\n", "ing", "日", "🙂", "<0x41>", "</s>", "x" * 70]) for _ in range(r.randrange(60))) for i in range(200)}
    out = sentencepiece_codec.encode(table(spark, docs))
    assert out.where("NOT agrees OR NOT round_trip").count() == 0
    assert rows(sentencepiece_codec.decode(out)) == Counter(docs.items())


def test_sentencepiece_models_of_other_kinds():
    """Messages written by hand: a model that is not of the merge type, a user's piece, a normaliser, white space that is cut."""
    for proto in (b"\x12\x02\x18\x01", b"\x0a\x02\x18\x04", b"\x1a\x05\x12\x01x\x20\x00", b"\x1a\x02\x20\x01", b"\x12\x05\x18\x02\xc0\x01\x01"):
        with pytest.raises(ValueError, match="vocabulary"):
            sentencepiece_codec.require_merge_type(proto)
    sentencepiece_codec.require_merge_type(b"\x12\x02\x18\x02\x1a\x02\x20\x00")


def test_sentencepiece_words_beyond_the_agendas_together(spark):
    r = random.Random(8)
    docs = {i: "".join(r.choice("abcdetinos") for _ in range(n)) for i, n in enumerate((1, 63, 64, 65, 200, 5000))} | {9: " " * 500 + "a", 10: "\n" * 300, 11: "▁▁a▁ b", 12: "日本" * 400}
    out = sentencepiece_codec.encode(table(spark, docs))
    assert out.where("NOT agrees").count() == 0 and out.where("NOT round_trip").select("doc_id").collect() == [(11,)]


def test_packing_as_brute_force(spark):
    r = random.Random(7)
    docs = {i: " ".join(["w"] * int(r.paretovariate(0.7))) if i % 9 else None for i in range(400)}
    assert rows(packing.best_fit_packing(table(spark, docs), 64)) == Counter(cases.pack(docs, 64))


def test_packing_awkward(messy, empty):
    got = packing.best_fit_packing(messy, 1000).collect()
    assert sum(r.n_words for r in got) == 2 * 30_000 + 4 * 2 + len(cases.words("Ünïcödé ▁ 日本\n\nnoch <s> mehr\x00?"))
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.bin_id, r.bin_offset)):
        assert ends[r.bin_id] == r.bin_offset
        ends[r.bin_id] += r.n_words
    assert max(ends.values()) <= 1000 and len(ends) == 61
    assert packing.best_fit_packing(empty).count() == 0


def test_simhash_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/sf0.01/documents.parquet")
    prints = {r.doc_id: (r.fa, r.fb) for r in simhash_dedup.fingerprints(docs).collect()}
    want, pairs = cases.near_groups(prints, simhash_dedup.DISTANCE, simhash_dedup.CONFIRM)
    got = dict((r.doc_id, r.kept_doc_id) for r in simhash_dedup.near_copies(docs).collect())
    found = simhash_dedup.near_pairs(spark.createDataFrame(sorted(set(prints.values())), "fa bigint, fb bigint"))
    near = {frozenset(((r.u.fa, r.u.fb), (r.v.fa, r.v.fb))) for r in found.collect()}
    true = {frozenset((prints[a], prints[b])) for a, b in pairs if prints[a] != prints[b]}
    assert near == true and got == want


def test_simhash_finds_every_pair_of_the_definition(spark):
    rng = random.Random(5)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(300)]
    # differing bits: as many in each block as its threshold, or one more in all but one
    split = [(3, 3, 4), (4, 3, 3), (3, 4, 3), (4, 4, 2), (10, 0, 0), (0, 10, 0), (0, 0, 10), (3, 2, 2), (5, 4, 1), (2, 5, 3)]
    prints = {}
    for i, (a, b) in enumerate(base):
        for (begin, bits), n in zip(((0, 22), (22, 21), (43, 21)), split[i % len(split)]):
            for k in rng.sample(range(begin, begin + bits), n):
                a ^= 1 << k
        for k in rng.sample(range(64), 12):
            b ^= 1 << k
        prints[2 * i], prints[2 * i + 1] = base[i], (a, b)
    prints = {d: tuple(x - (x >> 63 << 64) for x in p) for d, p in prints.items()}
    _, pairs = cases.near_groups(prints, 10, 12)
    found = simhash_dedup.near_pairs(spark.createDataFrame(list(prints.values()), "fa bigint, fb bigint"), 10, 12).collect()
    assert {frozenset(((r.u.fa, r.u.fb), (r.v.fa, r.v.fb))) for r in found} == {frozenset((prints[a], prints[b])) for a, b in pairs}
    assert len(pairs) >= 300 and len(found) == len(pairs)
    with pytest.raises(ValueError):
        simhash_dedup.near_pairs(spark.createDataFrame([], "fa bigint, fb bigint"), 11)


def test_simhash_recall_of_shingle_copies(spark):
    docs = spark.read.parquet(f"{SF}/sf0.1/documents.parquet").where("doc_id < 3000")
    later, pairs = cases.shingle_copies({r.doc_id: r.text for r in docs.dropDuplicates(["text"]).collect()}, 0.5)
    gone = {r.doc_id for r in simhash_dedup.near_copies(docs).collect()}
    assert len(later) > 50 and len(later & gone) >= 0.9 * len(later)


def test_simhash_awkward(messy, empty):
    assert rows(simhash_dedup.near_copies(messy)) == Counter({(2, 1): 1, (None, 1): 1, (7, 6): 1})
    kept = simhash_dedup.simhash_dedup(messy)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 3, 4, 5, 6, 8]) and kept.columns == messy.columns
    assert simhash_dedup.near_copies(empty).count() == simhash_dedup.simhash_dedup(empty).count() == 0


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/sf0.01/documents.parquet")
    named = docs.where("n_chars > 200 AND hash(doc_id) % 2 = 0")
    model = named.unionByName(docs.where("n_chars > 200 AND hash(doc_id) % 2 <> 0").selectExpr("doc_id", "text", "'?' AS lang", "source", "n_chars"))
    got = language_id.identify(model, 40).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 200 AND hash(doc_id) % 2 <> 0")
    right, n = got.selectExpr("sum(int(language = lang))", "count(*)").first()
    assert n > 200 and right >= 0.97 * n
    kept = language_id.keep_identified(docs)
    assert kept.count() >= 0.98 * docs.where("text rlike '[a-z]'").count()


def test_language_id_as_plain_scorer(spark):
    """Trigrams counted, weighted and voted on in plain Python, with the weights of the fitted machines."""
    docs = spark.read.parquet(f"{SF}/sf0.001/documents.parquet")
    model = language_id.Model(*language_id.sample(docs.select("doc_id", "text", "lang"), language_id.PER_LANGUAGE, sorted(language_id.FAMILIES)), language_id.FAMILIES)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    low = (1 << 32) - 1

    def winner(group, scores):
        wins = {k: [0, 0.0, []] for k in group}
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                s = scores[model.sides.index((a, b))]
                for k, x in ((a, s), (b, -s)):
                    wins[k][0] += x > 0
                    wins[k][1] += x
                    wins[k][2].append(x)
        best = max(group, key=lambda k: (wins[k][0], wins[k][1]))
        return best, min(wins[best][2], default=float("inf"))

    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].language is None
            continue
        raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in r.text.encode()) + b" "
        counts = Counter()
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            x = (a * 0x9E3779B1 & low) ^ (b * 0x85EBCA77 & low) ^ (c * 0xC2B2AE3D & low)
            counts[(x * 0x27D4EB2F & low) >> 19] += 1
        n = sum(counts.values())
        scores = [sum(k / n * float(model.table[g, m]) for g, k in counts.items()) + float(model.table[-1, m]) for m in range(model.table.shape[1])]
        family, margin = winner(model.names, scores)
        language, within = winner(model.members[family], scores)
        assert (got[r.doc_id].family, got[r.doc_id].language) == (family, language)
        assert abs(got[r.doc_id].margin - min(margin, within)) < 1e-4


def test_language_id_awkward(messy, empty):
    got = language_id.identify(messy).collect()
    assert len(got) == 10 and all((r.language is None) == (r.doc_id in (3, 4, 5)) for r in got)
    assert language_id.keep_identified(messy).columns == messy.columns
    assert language_id.identify(empty).count() == language_id.keep_identified(empty).count() == 0
    assert {r.language for r in language_id.identify(messy.where("doc_id = 6")).collect()} == {"fr"}


def test_line_dedup(messy, empty, spark):
    got = line_dedup.line_dedup(messy)
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 1, 3, 4, 5, 6, 8]) and got.columns == messy.columns
    assert line_dedup.line_dedup(empty).count() == 0
    r = random.Random(11)
    docs = {i: "\n".join(r.choice(["", " ", "x0B", "\v", f"line {r.randrange(90)}", f"Line {r.randrange(9)} "]) for _ in range(r.randrange(12))) for i in range(150)}
    want = Counter(cases.line_dedup(docs).items())
    assert rows(line_dedup.line_dedup(table(spark, docs))) == want
    assert rows(line_dedup.line_dedup(table(spark, docs), batches=5, fanout=2)) == want


def test_line_runs_are_merged_without_shuffle_or_sort(spark):
    runs = line_dedup.Runs(spark, 2)
    lines = spark.range(1000).selectExpr("id AS h1", "id * 7 AS h2", "id AS at")
    spark.conf.set(line_dedup.ORDERED, "true")
    try:
        for i in range(3):
            runs.add(lines.where(f"id % 3 <= {i}").groupBy("h1", "h2").agg(F.min("at").alias("at")))
        assert [len(x) for x in runs.levels] == [1, 1]
        for name in runs.tables():
            files = [f for f in os.listdir(runs.paths[name].removeprefix("file:")) if f.endswith(".parquet")]
            assert len(files) == 4  # one for each bucket
        plan = runs.merged(*runs.tables())._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert rows(runs.merged(*runs.tables())) == Counter((i, 7 * i, i) for i in range(1000))
    finally:
        spark.conf.set(line_dedup.ORDERED, "false")
        for name in runs.tables():
            runs.drop(name)


def test_sharding(messy, empty, spark):
    every = [(r.doc_id, r.text) for r in messy.collect()]
    assert rows(sharding.shard(messy, 20_000)) == Counter(cases.shards(every, 20_000))
    r = random.Random(13)
    docs = {i: "é" * r.randrange(60) for i in range(400)}
    assert rows(sharding.shard(table(spark, docs), 300, step=3)) == Counter(cases.shards([*docs.items()], 300))
    assert sharding.shard(empty).count() == 0
    # buckets of very different depths: one long text among many short ones
    uneven = [(i, "x" * (5000 if i % 97 == 0 else 3)) for i in range(600)]
    assert rows(sharding.shard(table(spark, dict(uneven)), 200)) == Counter(cases.shards(uneven, 200))
    assert sharding.directory_depth({3: 1, 4: 8, 9: 2}) == 7 and sharding.directory_depth({0: 1}) == 0 and sharding.directory_depth({1: 1, 60: 1}) == 5
