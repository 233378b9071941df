"""Near-duplicates, suffix dedup, packing, GIF, HTML and the pipeline: against brute force, and with odd rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import SF, frame
from tessera.llm import components, dom, gif_media, html_extraction, near_dedup, packing, suffix_dedup
from tessera.llm.example_pages import example_pages


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, n=3, percent=85):
    sets, root, seen = defaultdict(list), {}, defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            root[i] = i
            sets[i].append(shingles(t, n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for s in sets[i]:
            for j in {j for g in s for j in seen[g]}:
                union = max((100 * len(s & o) >= percent * len(s | o) for o in sets[j]), default=False)
                if union:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
            for g in s:
                seen[g].append(i)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 2, "block_shingles": 2000}])
def test_near_dedup(spark, odd_rows, documents, blocks):
    edited = []
    rng = random.Random(3)
    for k in range(40):
        w = f"start{k % 3} " .split() + [f"t{j % 211}" for j in range(120)]
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        edited.append((1000 + k, " ".join(w), "x"))
    for rows in (odd_rows, documents + edited):
        got = near_dedup.near_dedup(frame(spark, rows), **blocks).collect()
        want = brute_components(rows)
        assert len(got) == len(rows)
        for r in got:
            assert r.kept == (r.doc_id == r.component_id) if r.doc_id is not None else r.kept and r.component_id is None
            assert r.doc_id is None or r.component_id == want[r.doc_id]
    assert near_dedup.near_dedup(frame(spark, [])).isEmpty()
    assert sorted(r.doc_id or -1 for r in near_dedup.deduplicated(frame(spark, odd_rows)).collect()) == sorted({want_ for want_ in {brute_components(odd_rows)[i] for i, _, _ in odd_rows if i}} | {-1})


def test_sketch_estimates(spark):
    rng = np.random.default_rng(1)
    for share in (0.5, 0.7, 0.85, 0.95):
        both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        k = int(2000 * (1 - share) / (1 + share))
        a, b = np.unique(both), np.unique(np.concatenate([both[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
        x, y = (near_dedup.odd_sketch(near_dedup.samples(s)) for s in (a, b))
        bits = int(np.bitwise_count(x ^ y).sum())
        assert abs(near_dedup.similarity(bits) - share) < 0.12 and (share < 0.85 or bits <= near_dedup.MOST_BITS)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def brute_removed(rows, length, keep_first):
    order = sorted(range(len(rows)), key=lambda k: (-1 if rows[k][0] is None else rows[k][0]))
    raw, seen, count = [(t or "").encode() for _, t, _ in rows], {}, Counter()
    for k in order:
        for p in range(len(raw[k]) - length + 1):
            s = raw[k][p : p + length]
            count[s] += 1
            seen.setdefault(s, (rows[k][0], p))
    out = []
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if count[s] > 1 and not (keep_first and seen[s] == (rows[k][0], p)):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((rows[k][0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [4000, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup(spark, odd_rows, documents, most, keep_first):
    short = [(i, t[:30_000] if t else t, s) for i, t, s in odd_rows]
    rows = short + [(i + 100, t, s) for i, t, s in documents[:60]] + [(300, "ab" * 500, "p"), (301, "ab" * 450, "p")]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), keep_first=keep_first, most=most).collect()
    mine = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert mine == brute_removed(rows, 400, keep_first)
    assert suffix_dedup.suffix_dedup(frame(spark, [])).isEmpty()


def test_previous_factors():
    rng = np.random.default_rng(2)
    for sizes, letters in (([500], 3), ([40, 9, 200, 7, 100], 2), ([60] * 5, 1), ([1, 2, 3], 1)):
        texts = [bytes(rng.integers(0, letters, n).astype(np.uint8)) for n in sizes]
        symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.uint64)
        end = np.cumsum(np.array(sizes) + 1) - 1
        ends = np.repeat(end, np.array(sizes) + 1)
        starts = np.flatnonzero(np.arange(len(symbols)) < ends)
        source, length = suffix_dedup.previous_factors(symbols, ends, starts)

        def shared(i, j):
            n = 0
            while i + n < ends[i] and j + n < ends[j] and symbols[i + n] == symbols[j + n]:
                n += 1
            return n

        for k, i in enumerate(starts):
            assert length[k] == max([shared(i, j) for j in starts[:k]], default=0)
            assert (source[k] == -1) == (length[k] == 0) and (length[k] == 0 or source[k] < k and shared(i, starts[source[k]]) == length[k])


def test_smaller_neighbours():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 301):
        for v in (rng.permutation(n), np.arange(n), np.arange(n)[::-1]):
            before = [max([j for j in range(i) if v[j] < v[i]], default=-1) for i in range(n)]
            after = [min([j for j in range(i + 1, n) if v[j] < v[i]], default=-1) for i in range(n)]
            assert list(suffix_dedup.previous_smaller(v)) == before and list(suffix_dedup.next_smaller(v)) == after


def test_packing(spark, odd_rows, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for rows, per_part in ((odd_rows, 3), (documents, 8000), (documents, 20)):
        got = packing.best_fit_packing(frame(spark, rows), per_part=per_part).collect()
        want = Counter()
        for i, t, _ in rows:
            ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
            first = len(ids) % 2048 or 2048
            edges = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, z) in enumerate(zip(edges, edges[1:])):
                want[(i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 2048
        least = -(-sum(r.length for r in got) // 2048)
        assert len(bins) <= least * 1.05 + 1
    assert packing.best_fit_packing(frame(spark, [])).isEmpty()


def test_lzw_and_frames():
    rng = random.Random(1)
    for depth in (2, 4, 8):
        for n in (1, 63, 5000, 40_000):
            data = bytes(rng.randrange(rng.choice([1, 2, 1 << depth])) for _ in range(n))
            assert gif_media.lzw_decode(gif_media.lzw_encode(data, depth), depth, n).tobytes() == data
    with pytest.raises(ValueError):
        list(gif_media.decode_gif(b"nothing"))


def _gif(frames, width=2, height=2):
    """frames: (disposal, transparent or None, x, y, w, h, samples)."""
    out = b"GIF89a" + bytes([width, 0, height, 0, 0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for disposal, clear, x, y, w, h, samples in frames:
        out += bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, 0, clear or 0, 0, 0x2C, x, 0, y, 0, w, 0, h, 0, 0, 2])
        stream = gif_media.lzw_encode(bytes(samples), 2)
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_disposal_and_transparency():
    raw = _gif([(1, None, 0, 0, 2, 2, [1, 1, 1, 1]), (2, 0, 0, 0, 2, 1, [0, 2]), (3, None, 1, 1, 1, 1, [3]), (0, None, 0, 1, 1, 1, [2])])
    shown = [[tuple(p) for p in f.canvas.reshape(-1, 4).tolist()] for f in gif_media.decode_gif(raw)]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert shown == [[red] * 4, [red, green, red, red], [none, none, red, blue], [none, none, green, red]]


def test_gif_media(spark, odd_rows):
    got = gif_media.gif_media(frame(spark, odd_rows)).collect()
    want = Counter()
    for i, t, _ in odd_rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (4, None)}) == 1
    frames = gif_media.frame_table(gif_media.media_table(frame(spark, odd_rows))).collect()
    assert len(frames) == len(odd_rows) and all(sum(f.histogram) * 4 == len(f.pixels) for f in frames)


def test_pages(spark):
    got = {r.page_id: r for r in html_extraction.op1_html_extraction(spark, SF).collect()}
    for i, url, page in duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall():
        part = re.sub(r"<[^>]*$", "", page[page.find("<article>") : (page + "</article>").find("</article>")])
        blocks = re.sub(r"</?b>", "", re.sub("<br>", " ", re.sub(r"</?(article|h1|p)>", "\0", part))).split("\0")
        text = " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))


def test_articles_without_an_element_of_their_own():
    one, two = "Para number one is here with some words to read, and to keep.", "The second of the paragraphs has words as well, and more of them than the first."
    both, nav, foot = f"<p>{one}</p><p>{two}</p>", '<nav><a href="/a">Home</a><a href="/b">News</a></nav>', "<footer>&copy; site</footer>"
    cases = {both: f"{one} {two}", f"<html><body>{both}</body></html>": f"{one} {two}", f"<body>{nav}<h1>Title</h1>{both}{foot}": f"Title {one} {two}", f"{one} {two}": f"{one} {two}"}
    assert html_extraction.train().texts(list(cases)) == list(cases.values())


def test_extraction_of_unseen_pages_and_odd_rows(spark):
    model, right, of = html_extraction.train(), 0, 0
    for page in example_pages(60, seed=77):
        tree = dom.parse(page, labelled=True)
        y = html_extraction._labels(tree)
        kept = dom.decode(tree, model.trees.logit(dom.features(tree, model.tag_odds, model.token_odds)))
        assert all(kept[p] or not k for k, p in zip(kept, tree.parent) if p >= 0)
        for k, t in enumerate(tree.text):
            if t is not None:
                right, of = right + len("".join(t)) * (kept[k] == bool(y[k])), of + len("".join(t))
    assert right / of > 0.9
    plain = "<p>One sentence <b>is</b> here, and goes on.</p>"
    assert dom.parse(plain.replace("<b>", '<b data-y="0">')).tag == dom.parse(plain).tag  # the label of training pages means nothing elsewhere
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a&amp;b<p>c"), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<div" * 500), (6, "u", "</p></div><!-- x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html_extraction.html_extraction(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.html_extraction(pages.limit(0)).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == columns
        if k < 2:
            assert docs.join(before, "doc_id", "left_anti").isEmpty() and 0 < docs.count() <= before.count()
        if k == 1:
            assert {r.doc_id for r in docs.collect()} == set(brute_components([(r.doc_id, r.text, None) for r in before.collect()], 5, 80).values())
        if k == 2:
            assert docs.count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
