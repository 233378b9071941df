"""Very long runs of white space, of one letter and of special strings are packed with the tokenizer's own ids."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helpers import frame
from tessera.llm import packing


def test_long_runs(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, " " * 1_000_000, "a"), (2, "\n" * 1_000_000, "a"), (3, "z" * 100_000, "a"), (4, "<|endoftext|>" * 3000, "a"), (5, None, "a")]
    got = packing.best_fit_packing(frame(spark, rows), per_part=50).collect()
    for i, t, _ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert mine == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n, _ in mine] and sum(n for _, n, _ in mine) == len(ids)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_many_parts_fill_as_well_as_one(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 2048, 6000).tolist()
    items = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    bins = {}
    for per_part in (6000, 500):
        got = packing.pack(items, per_part=per_part).collect()
        bins[per_part] = len({r.sequence_id for r in got})
        assert len(got) == len(sizes) and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert bins[500] <= bins[6000] * 1.03


def test_words_of_all_code_points():
    encode = packing.encoder("byte_bpe_50k")
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b  {chr(c)}\n{chr(c)} " for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 17 == 0)]
    want = encode.whole.encode_batch_fast(texts, add_special_tokens=False)
    assert all(x.tolist() == y.ids for x, y in zip(encode(texts), want))
