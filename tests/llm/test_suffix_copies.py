"""Spans of repeated rows do not add up, and the text that remains is what the digest says."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from helpers import frame
from tessera.llm import suffix_dedup

TEXT = " ".join(f"word{k * 7919 % 997}" for k in range(3000))


def test_copies_share_their_spans(spark):
    rows = [(1, TEXT, "a")] * 12 + [(2, TEXT[:9000] + " tail é " + TEXT[5000:5300], "a"), (None, "x" + TEXT, "b")]
    docs = frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("_row"))
    spans = suffix_dedup.repeated_spans(docs).distinct()
    one = spans.groupBy("_row").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert one < 2 * len(TEXT) // 100
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got[1].n_removed == got[1].n_bytes and got[1].text == "" and got[None].text == "x"
    assert got[2].text == " tail é " + TEXT[5000:5300] and got[2].kept_sha256 == hashlib.sha256(got[2].text.encode()).hexdigest()


def brute(rows, length=400):
    raw, seen, twice = [(i, (t or "").encode()) for i, t in rows], set(), set()
    for _, b in raw:
        for p in range(len(b) - length + 1):
            h = hash(b[p : p + length])
            (twice if h in seen else seen).add(h)
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if hash(b[p : p + length]) in twice:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    want = brute(duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall())
    got = suffix_dedup.op10_suffix_dedup(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got.collect()} == want


def test_a_gram_with_thousands_of_segments(spark, monkeypatch):
    """One passage with a different word before and after it in each document, some of which agree on their part of the surroundings."""
    passage = " ".join(f"shared{k * 31 % 89}" for k in range(45))
    rows = [(k, f"{k * 7919 % 10007:05d} before{k % 1700} {passage} after{k % 2300} {k:05d}", "s") for k in range(5000)]
    want = brute([(i, t) for i, t, _ in rows])
    crowded, of = [], suffix_dedup._crowded
    monkeypatch.setattr(suffix_dedup, "_crowded", lambda many, *rest: crowded.append(many.count()) or of(many, *rest))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got == want
    assert crowded and crowded[0] > 1000 and any(x[1] for x in got.values())
