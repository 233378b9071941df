"""MinHash near-dedup with odd sketches: bands of MinHash samples give candidates, parity bitmaps of the samples estimate their similarity
by XOR population counts, and links are confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, hash_parts, salted_join, small_batches, table, text_or_empty
from tessera.llm.components import components

WORDS, PERCENT = 3, 85
SAMPLES, BITS = 336, 512


def band_rows(percent: int) -> int:
    """The most samples a band may have so that a pair at this similarity misses all bands with a probability under 1e-7: 7 at 85, 6 at 80."""
    return max((r for r in range(1, 9) if (1 - (percent / 100) ** r) ** (SAMPLES // r) < 1e-7), default=1)


_U = np.uint64
_rng = np.random.default_rng(20240229)
_TIMES = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1))[None, :]
_MASKS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[None, :]
_MIX = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | _U(1)
_BLOCK, _SPACES = 1 << 19, re.compile(rb"[\x20\x09-\x0D]")
_BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every input bit moves about half of the output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n; kept between calls, since batches repeat."""
    if len(_powers.kept[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.kept = tuple(out)
    return _powers.kept


_powers.kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, by differences of one running polynomial, and how many words each text has."""
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    start = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    power, inverse = _powers(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * power[: len(b)], out=run[1:])
    h = mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return h, np.diff(np.searchsorted(start, np.cumsum([1, *(len(r) + 1 for r in raw)])))


def _stretches(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(raw):
        space = _SPACES.search(raw, at + _BLOCK)
        end = space.start() if space else len(raw)
        yield raw[at:end]
        at = end


def _sets(h: np.ndarray, counts: np.ndarray, words: int) -> list[np.ndarray]:
    rolled = [h]
    for k in range(1, words):
        rolled.append(mix(rolled[-1][: max(0, len(h) - k)] * _U(0xD6E8FEB86659FD93) + h[k:]))
    out, a = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[-1][a : a + n - words + 1]))
        else:
            out.append(rolled[n - 1][a : a + 1] ^ _U(n) if n else h[:0])
        a += n
    return out


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, from blocks of short texts or parts of long ones, so the memory is bounded."""
    out, block, size = [], [], 0
    for text in [*texts, None]:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if block and (text is None or size + len(raw) > _BLOCK):
            out += _sets(*_word_hashes(block), words)
            block, size = [], 0
        if len(raw) > _BLOCK:
            h = np.concatenate([_word_hashes([part])[0] for part in _stretches(raw)])
            out += _sets(h, np.array([len(h)]), words)
        elif text is not None:
            block.append(raw)
            size += len(raw)
    return out


def samples(own: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set."""
    x = (own >> _U(32)).astype(np.uint32)[:, None]
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(least, ((x[k : k + 256] * _TIMES) ^ _MASKS).min(0), out=least)
    return least


def band_keys(sample: np.ndarray, rows: int) -> np.ndarray:
    bands = SAMPLES // rows
    x = mix(sample.astype(np.uint64) * _MIX + _MIX)[: bands * rows].reshape(bands, rows).sum(1, dtype=np.uint64)
    return mix(x + np.arange(bands, dtype=np.uint64)).view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """The parity of how many samples fall on each bit."""
    at = mix(sample.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << _U(32))) % _U(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1).view(np.uint64)


def similarity(differing: float) -> float:
    """The similarity that a count of differing bits of two sketches estimates."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * differing / BITS))


def _bits_at(similar: float, sigmas: float = 6.0) -> int:
    """As many differing bits as a pair of this similarity has at most, but for a probability beyond `sigmas` deviations."""
    low = max(0.05, similar - sigmas * math.sqrt(similar * (1 - similar) / SAMPLES))
    mean = BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - low) / BITS))
    return min(BITS, math.ceil(mean + sigmas / 2 * math.sqrt(BITS) / 2))


MOST_BITS = _bits_at(PERCENT / 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Texts:
    """Texts of a group with their sizes and sketches; a shingle set is made when a pair survives both filters."""

    def __init__(self, g: pd.DataFrame, words: int, percent: int) -> None:
        self.texts, self.words, self.percent, self.most_bits = g["text"].tolist() if "text" in g else None, words, percent, _bits_at(percent / 100)
        self.sizes = g["n_shingles"].to_numpy(np.int64)
        self.sketches = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), BITS // 64)
        self.sets: dict[int, np.ndarray] = {}

    def similar(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that may be linked with x, by size and by the XOR of odd sketches."""
        small, large = np.minimum(self.sizes[others], self.sizes[x]), np.maximum(self.sizes[others], self.sizes[x])
        others = others[100 * small >= self.percent * large]
        return others[np.bitwise_count(self.sketches[others] ^ self.sketches[x]).sum(1) <= self.most_bits]

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that are linked with x, on the full sets."""
        similar = self.similar(x, others)
        new = [k for k in [x, *similar.tolist()] if k not in self.sets]
        if len(similar) and new:
            self.sets.update(zip(new, shingle_sets([self.texts[k] for k in new], self.words)))
        return np.array([o for o in similar.tolist() if linked(self.sets[o], self.sets[x], self.percent)], np.int64)


def _describe(batches: Iterator[pd.DataFrame], words: int, rows: int) -> Iterator[pd.DataFrame]:
    for part in batches:
        sets = shingle_sets(part["text"].tolist(), words)
        least = [samples(s) if len(s) else None for s in sets]
        yield pd.DataFrame({
            "doc_id": part["doc_id"].to_numpy(),
            "text_key": part["text_key"].to_numpy(),
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "n_shingles": [len(s) for s in sets],
            "bands": [band_keys(m, rows) if m is not None else np.zeros(0, np.int64) for m in least],
            "sketch": [odd_sketch(m).tobytes() if m is not None else None for m in least],
        }).astype({"doc_id": "Int64"})


def _spread(start: int, stop: int, root: np.ndarray, node: np.ndarray, find) -> None:
    """Writes to root which of the rows from start to stop are connected: each reached row is compared with all that are not yet reached."""
    left = np.arange(start, stop)
    while len(left):
        first, left = left[0], left[1:]
        queue = [int(first)]
        while queue and len(left):
            got = find(queue.pop(), left)
            root[got] = node[first]
            queue += got.tolist()
            left = left[~np.isin(left, got)] if len(got) else left


def _groups(g: pd.DataFrame, by: list[str]) -> list[tuple[int, int]]:
    new = np.flatnonzero((g[by] != g[by].shift()).any(axis=1))
    return list(zip(new, [*new[1:], len(g)]))


def _sketch_groups(g: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Parts of candidate components that sketches connect, without texts; a row that no sketch connects is left out."""
    g = g.sort_values(["comp", "node"], kind="stable").reset_index(drop=True)
    t, node = _Texts(g, words, percent), g["node"].to_numpy()
    root = node.copy()
    for a, z in _groups(g, ["comp"]):
        _spread(a, z, root, node, t.similar)
    out = pd.DataFrame({"node": node, "comp": root})
    return out[out.groupby("comp")["node"].transform("size") > 1]


def _link_groups(g: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Within each (comp, block): which texts are connected by links on the full sets."""
    g = g.sort_values(["comp", "block", "node"], kind="stable").reset_index(drop=True)
    t, node = _Texts(g, words, percent), g["node"].to_numpy()
    root = node.copy()
    for a, z in _groups(g, ["comp", "block"]):
        _spread(a, z, root, node, t.near)
        t.sets.clear()
    return pd.DataFrame({"node": node, "root": root})


def _link_across(g: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Links of the texts marked `out` with the block's texts under other labels."""
    g = g.reset_index(drop=True)
    t = _Texts(g, words, percent)
    node, label, out, where = (g[c].to_numpy() for c in ("node", "label", "out", "where"))
    rows = []
    for w in np.unique(where):
        inside = np.flatnonzero(~out & (where == w))
        for x in np.flatnonzero(out & (where == w)):
            rows += [(node[x], node[o]) for o in t.near(int(x), inside[label[inside] != label[x]])]
    return pd.DataFrame(rows, columns=["node", "root"], dtype="int64")


def _verified(texts: DataFrame, candidates: DataFrame, block_docs: int, block_shingles: int, words: int, percent: int) -> DataFrame:
    """(u, v) edges between texts that are linked, enough of them to connect what all links connect.

    texts: node, text_key, text. candidates: comp, node, text_key, n_shingles, sketch. Components of at most block_docs texts are first
    parted by sketches alone, and texts that no sketch connects go no further. A component of more is dealt to blocks. Each block also
    gets the component's first text, so tight groups connect through it; texts outside a component's largest part are then compared with
    every other block.
    """
    columns = ["comp", "node", "text_key", "n_shingles", "sketch"]
    sized = candidates.groupBy("comp").agg(F.count("*").alias("_n"))
    both = cut(salted_join(candidates, sized, ["comp"], 8, F.xxhash64("node")), "candidates-sized")
    small = both.where(F.col("_n") <= block_docs).select(*columns)
    bins = hash_parts(small.count(), 4 * block_docs)
    light = small.select(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin"), "comp", "node", "n_shingles", "sketch")
    parted = light.groupBy("bin").applyInPandas(lambda g: _sketch_groups(g, words, percent), "node long, comp long").distinct()
    candidates = cut(small.drop("comp").join(parted, "node").select(*columns).unionByName(both.where(F.col("_n") > block_docs).select(*columns)), "candidates-by-sketch")
    discard(both)
    comp = candidates.groupBy("comp").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_s"))
    comp = comp.select("comp", F.ceil(F.greatest(F.col("_n") / block_docs, F.col("_s") / block_shingles)).cast("int").alias("blocks"))
    placed = cut(salted_join(candidates, comp, ["comp"], 8, F.xxhash64("node")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    discard(candidates)
    total = placed.agg(F.count("*"), F.sum("n_shingles")).first()
    bins = max(hash_parts(total[0], block_docs // 2), hash_parts(total[1] or 0, block_shingles // 2))
    # The texts of candidates are shuffled out of all texts once; the table that holds them serves the second comparison too.
    with_text = cut(texts.join(placed, ["node", "text_key"]).dropDuplicates(["node", "text_key", "comp"]), "candidate-texts")
    first = F.col("node") == F.col("comp")
    everywhere = with_text.where(first).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    batches = with_text.where(~first).unionByName(everywhere).select(F.pmod(F.xxhash64("comp", "block"), F.lit(bins)).alias("bin"), "comp", "block", "node", "n_shingles", "sketch", "text")
    found = cut(batches.groupBy("bin").applyInPandas(lambda g: _link_groups(g, words, percent), "node long, root long"), "links").select(F.col("node").alias("u"), F.col("root").alias("v"))
    hot = placed.where(F.col("blocks") > 1)
    if hot.isEmpty():
        discard(with_text, placed)
        return found
    label = components(found)
    labelled = cut(hot.join(label, "node", "left").withColumn("label", F.coalesce("root", "node")).select("node", "comp", "block", "blocks", "label"), "labelled")
    parts = labelled.groupBy("comp", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("comp").agg(F.max(F.struct("n", "label"))["label"].alias("largest"))
    outside = cut(salted_join(labelled, largest, ["comp"], 8, F.xxhash64("node")).where(F.col("label") != F.col("largest")), "outside")
    if outside.isEmpty():
        discard(with_text, placed, labelled, outside)
        return found
    chunks = outside.groupBy("comp").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("chunks"))
    here = salted_join(labelled, chunks, ["comp"], 8, F.xxhash64("node")).withColumn("at", F.expr("transform(sequence(0, chunks - 1), c -> xxhash64(comp, block, c))")).withColumn("out", F.lit(False))
    there = outside.join(chunks, "comp").withColumn("_c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("at", F.expr("transform(sequence(0, blocks - 1), b -> xxhash64(comp, b, _c))")).withColumn("out", F.lit(True))
    columns = ["node", "label", "out", "at"]
    moved = with_text.select("node", "n_shingles", "sketch", "text").join(here.select(*columns).unionByName(there.select(*columns)), "node").withColumn("where", F.explode("at")).drop("at")
    across = moved.groupBy("where").applyInPandas(lambda g: _link_across(g, words, percent), "node long, root long")
    more = cut(across, "links").select(F.col("node").alias("u"), F.col("root").alias("v"))
    discard(with_text, placed, labelled, outside)
    return found.unionByName(more)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 500, block_shingles: int = 1_000_000,
    words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (long), component_id, kept.

    Shingles have `words` words; two texts are linked when 100 * intersection >= percent * union of their shingle sets.
    Texts with equal shingle sets are one class, whose smallest doc_id stands for it; classes that share a band of samples are
    candidates, the XOR of odd sketches verifies them, and links are confirmed on the full sets. Null and empty texts have no shingles and are linked with nothing. Rows
    that share a doc_id are one document for the links. A row with a null doc_id is linked with nothing, has a null component_id and is
    kept. Long texts are hashed in parts that end between words, and all their shingles count. Ties do not occur, as ids order all. Empty
    tables give empty results. Other columns are neither read nor returned.
    """
    per_band = band_rows(percent)
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    described = cut(own.mapInPandas(lambda batches: _describe(batches, words, per_band), "doc_id long, text_key long, digest binary, n_shingles long, bands array<long>, sketch binary"), "minhash")
    rows = cut(described.select("doc_id", "text_key", "digest", "n_shingles"), "digests")
    usable = described.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("node"), "text_key")).alias("_r"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    banded_classes = cut(classes.select("digest", "_r.*", "n_shingles", "bands", "sketch"), "banded-classes")
    discard(described)
    classes = cut(banded_classes.drop("bands"), "classes")
    banded = banded_classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("_last")).where(F.col("v") < F.col("_last")).drop("_last")
    stars = banded.join(buckets, "band").where(F.col("node") > F.col("v")).select(F.col("node").alias("u"), "v").distinct()
    near = components(stars)
    discard(banded_classes)
    comps = cut(near.select("node", F.col("root").alias("comp")).unionByName(near.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct()), "candidates")
    # A document whose rows hold several texts has several classes, which stay together.
    candidates = classes.select("node", "text_key", "n_shingles", "sketch").join(comps, "node")
    root = components(_verified(own.withColumnRenamed("doc_id", "node"), candidates, block_docs, block_shingles, words, percent))
    by_class = classes.select("digest", "node").join(root, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    # The rows of a much copied class are narrow and on the side that adaptive execution splits.
    out = rows.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left").drop("digest")
    same = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("component_id", same).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document near_dedup keeps, with docs' columns, whatever their names.

    Of rows with one id and one text the first by the other columns stays; rows with one id and unlike texts stay. Rows with a null id
    stay, as do null and empty texts, which are linked with nothing. An empty table gives an empty result.
    """
    ids = near_dedup(docs, id_col, text_col, words=words, percent=percent).where(F.col("doc_id").isNotNull() & F.col("kept")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    ids = cut(ids, "kept-ids")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    stay = row.join(ids, "doc_id")
    several = stay.where(F.col("rows") > 1)
    others = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and f.dataType.typeName() not in ("map", "variant")]
    one = several.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", F.col(f"row.`{text_col}`")).orderBy(*others, F.lit(0)))).where(F.col("_k") == 1)
    return stay.where(F.col("rows") == 1).select("row").unionByName(one.select("row")).unionByName(row.where(F.col("doc_id").isNull()).select("row")).select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) >= 3)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, component_id, w.doc_id = component_id kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
