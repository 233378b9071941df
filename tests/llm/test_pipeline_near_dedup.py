"""The pipeline's near-dedup stage, asked for five words and 0.8, against brute force."""

import re

import pytest

import corpus_pipeline
from helpers import frame
from tessera.llm import near_dedup


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_kept(rows, words, percent):
    root, sets = {i: i for i, _, _ in rows}, [(i, shingles(t, words)) for i, t, _ in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, o in sets[:k]:
            if s and o and 100 * min(len(s), len(o)) >= percent * max(len(s), len(o)) and 100 * len(s & o) >= percent * len(s | o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def test_stage_takes_five_words_and_eighty_percent(spark, documents):
    own = [f"b{j}" for j in range(200)]
    scattered = [f"x{j}" if j % 30 == 15 else f"c{j}" for j in range(300)]  # ten changed words: 0.82 at three words, 0.71 at five
    some = [f"s{j}" if j % 60 == 30 else f"c{j}" for j in range(300)]  # five changed words: 0.90 and 0.84
    edits = [own, own + [f"n{j}" for j in range(42)], own + [f"m{j}" for j in range(60)], [f"c{j}" for j in range(300)], scattered, some, [f"d{j}" for j in range(5)], [f"d{j}" for j in range(4)]]
    edits += [[f"e{j}" for j in range(300)], [f"y{j}" if j % 43 == 20 else f"e{j}" for j in range(300)]]  # seven changed words: 0.87 and 0.79
    rows = documents + [(10_000 + k, " ".join(w), "x") for k, w in enumerate(edits)]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "", words=5, percent=80).collect()}
    want = brute_kept(rows, 5, 80)
    assert got == want != brute_kept(rows, 3, 85)
    assert 10_001 not in got and 10_009 in got


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_bands_keep_recall(percent):
    r = near_dedup.band_rows(percent)
    assert (1 - (percent / 100) ** r) ** (near_dedup.SAMPLES // r) < 1e-7
    assert near_dedup.band_rows(85) == 7
