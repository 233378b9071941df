"""Each stage on its own input: against its operator's verdicts, with odd rows and with an empty table."""

import os
from collections import Counter

import corpus_pipeline
from helpers import SF, frame
from tessera.llm import mixing, packing, quality_classifier


def test_stages_take_odd_and_empty_tables(spark, odd_rows):
    docs = frame(spark, odd_rows)
    ids = Counter(r.doc_id for r in docs.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).isEmpty(), name
        rows = got.collect()
        if k < 4:
            assert got.columns == docs.columns and {r.doc_id for r in rows} <= set(ids)
        if name in ("secret scan", "packing"):
            assert {r.doc_id for r in rows} == set(ids)
        if name == "near-dedup":
            # 5 shares its text but for one word with 4, whose two rows are one; ids that are null stay.
            assert Counter(r.doc_id for r in rows) == Counter(i for i in ids if i != 5)


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "one two three four five six seven", "a"), (1, "quite another text with words of its own", "b"), (1, "one two three four five six seven", "c"), (2, "one two three four five six seven", "a")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()
    assert sorted((r.doc_id, r.text[:5], r.source) for r in got) == [(1, "one t", "a"), (1, "quite", "b")]


def test_stages_follow_their_operators(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.quality_classifier(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == good
    taken = Counter(r.doc_id for r in mixing.mix_sources(docs).collect())
    assert Counter(r.doc_id for r in corpus_pipeline.mixture(spark, docs, SF).collect()) == taken
    pieces = Counter(map(tuple, packing.pieces(docs).collect()))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.packed(spark, docs, SF).collect()) == pieces


def test_a_run_leaves_its_last_table_only(spark):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-packing") and got.count() > 0
