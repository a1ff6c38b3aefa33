"""The pipeline against brute-force versions of its stages, each on its own input."""

import os
from collections import Counter

import cases
import corpus_pipeline

from kinograph.llm import _common, language_id, packing, simhash_dedup

D = "/root/testdata/sf0.001"


def files(spark):
    return set(os.listdir(_common.shared_folder(spark).removeprefix("file:")))


def test_pipeline(spark):
    there = files(spark)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in language_id.identify(docs).where(f"language IS NOT NULL AND (margin IS NULL OR margin >= {language_id.MIN_MARGIN})").collect()}
    lined = cases.line_dedup({d: t for d, t in before.items() if d in known})
    table = spark.createDataFrame([*lined.items()], "doc_id bigint, text string")
    prints = {r.doc_id: (r.fa, r.fb) for r in simhash_dedup.fingerprints(table).collect()}
    gone, _ = cases.near_groups(prints, simhash_dedup.DISTANCE, simhash_dedup.CONFIRM)
    cut = cases.cut_repeats({d: t for d, t in lined.items() if d not in gone}, 50)
    got = Counter(map(tuple, corpus_pipeline.run(spark, D).collect()))
    assert got == Counter(cases.pack(cut, packing.CAPACITY))
    left = files(spark) - there
    assert not [x for x in left if x.startswith(("run-", "lines-", *(name for name, _ in corpus_pipeline.STAGES)))]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        assert out.where("n_chars <> length(text)").count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0
