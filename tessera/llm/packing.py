"""Best-fit packing by hierarchical residual packing: parts pack best-fit, full and nearly full bins leave, and the underfull bins are
merged up a tree as items of further best-fit rounds."""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, hash_parts, small_batches, table, text_or_empty

CAPACITY = 2048
_ENCODERS: dict = {}


class _Words(dict):
    """The ids of each word that was asked for, as bytes."""

    def __init__(self, tokenize) -> None:
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
        others = [b for b in range(256) if b not in printed]
        self.tokenize, self.written, self.chars = tokenize, {b: 256 + k for k, b in enumerate(others)}, 0
        self.space = chr(self.written[32])

    def __missing__(self, word: str) -> bytes:
        self.chars += len(word)
        bare = word[word[0] == " " :]
        if bare.isascii() and bare.isalpha():
            written = word if bare is word else self.space + bare
        else:
            written = word.encode().decode("latin-1").translate(self.written)
        ids = array("I", [t.id for t in self.tokenize(written)]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """texts -> arrays of ids of the public tokenizer <vocabulary>.json.

    Where that splits by its byte-level pattern only, the ids of a word follow from the word alone: texts are split by the same pattern, and
    the tokenizer's model encodes each new word once. Texts that hold a special token's string, and other tokenizers, take the whole way.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        byte_level = isinstance(self.whole.pre_tokenizer, pre_tokenizers.ByteLevel) and not self.whole.pre_tokenizer.add_prefix_space and self.whole.normalizer is None
        self.split = regex.compile(public_tokenizers.PATTERN).findall if byte_level else None
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = _Words(self.whole.model.tokenize)

    def _by_words(self, text: str) -> np.ndarray:
        if len(self.words) > 1 << 19 or self.words.chars > 1 << 23:
            self.words.clear()
            self.words.chars = 0
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), "<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        by_words = [self.split is not None and not any(s in t for s in self.special) for t in texts]
        rest = iter(self.whole.encode_batch_fast([t for t, fast in zip(texts, by_words) if not fast], add_special_tokens=False))
        return [self._by_words(t) if fast else np.array(next(rest).ids, "<u4") for t, fast in zip(texts, by_words)]


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _slices(lengths: list[int], most: int) -> Iterator[slice]:
    """Slices of rows whose lengths add up to at most `most`, or of one longer row."""
    at, size = 0, 0
    for k, n in enumerate(lengths):
        if k > at and size + n > most:
            yield slice(at, k)
            at, size = k, 0
        size += n
    if lengths:
        yield slice(at, len(lengths))


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: the rest first, then whole pieces."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for b in batches:
            rows, texts = [], b["text"].tolist()
            for part in _slices([len(t) for t in texts], 1 << 20):
                for doc, ids in zip(b["doc_id"].iloc[part], encode(texts[part])):
                    ids = np.append(ids, np.zeros(1, "<u4"))
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(doc, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(edges, edges[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return own.mapInPandas(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit of items in the order given: the bin and the place of each item, and the bins' fills. The bins are listed by the room they
    have, and the least room that suffices is the lowest bit of a mask."""
    room: dict[int, list[int]] = {}
    mask, of, at, fills = 0, [], [], []
    for size in sizes:
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, k = capacity, len(fills)
            fills.append(0)
        of.append(k)
        at.append(fills[k])
        fills[k] += size
        if r > size:
            room.setdefault(r - size, []).append(k)
            mask |= 1 << (r - size)
    return of, at, fills


def _pack(items: DataFrame, parts: int, level: int, capacity: int, key: list[str], fan_in: int, nearly: int) -> DataFrame:
    """items with size and the columns of key, packed within each of `parts` parts: adds bin, offset, fill and goes_on.

    goes_on marks bins that the next level may fill: those with room, but of equally full bins over half only fan_in, for best-fit leaves
    at most one bin under half in a part, and a group of fan_in parts so has at most fan_in bins that fit into others.
    """

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", *key], ascending=[False, *[True] * len(key)], kind="stable")
        of, at, fills = best_fit(g["size"].tolist(), capacity)
        first = (level << 52) + (int(g["part"].iloc[0]) << 26)
        seen: Counter = Counter()
        open_ = []
        for fill in fills:
            seen[fill] += 1
            open_.append(fill <= capacity - nearly and (fill <= capacity // 2 or seen[fill] <= fan_in))
        of = np.array(of, "int64")
        return g.assign(bin=of + first, offset=np.array(at, "int64"), fill=np.array(fills, "int64")[of], goes_on=np.array(open_)[of]).drop(columns="part")

    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", bin long, offset long, fill long, goes_on boolean"
    return items.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("long")).groupBy("part").applyInPandas(pack, schema)


def pack(parts_of: DataFrame, capacity: int = CAPACITY, per_part: int = 8_000, fan_in: int = 8, nearly: int = 8) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32); an empty table gives an empty result.

    Level 0 packs parts of about per_part items. A bin with less than `nearly` room, or less than the smallest open bin's fill, leaves.
    The others are items of the next level, which has a fan_in-th of the parts. What goes on from a part is bounded by fan_in bins a
    fill, so the last level's one part stays small whatever the input. Whole pieces are sequences of their own, with negative numbers.
    Repeated rows and null ids are items like others; ties of size are settled by doc_id and piece, and equal rows are interchangeable.
    """
    whole = parts_of.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    items = parts_of.where(F.col("length") < capacity).withColumn("size", F.col("length"))
    parts = hash_parts(items.count(), per_part)
    placed = cut(_pack(items, parts, 1, capacity, ["doc_id", "piece"], fan_in, nearly), "packed").drop("size")
    one_each = lambda df: df.groupBy("bin").agg(F.max("fill").alias("size"), F.max("goes_on").alias("goes_on")).where("goes_on").drop("goes_on")
    bins = one_each(placed)
    to, level = None, 1
    while parts > 1:
        state = bins.agg(F.min("size"), F.count_if(F.col("size") <= capacity // 2)).first()
        least, small = state[0], state[1]
        if not small:
            break
        parts, level = -(-parts // fan_in), level + 1
        useful = bins.where(F.col("size") <= capacity - least)
        moved = cut(_pack(useful.withColumnRenamed("bin", "from"), parts, level, capacity, ["from"], fan_in, nearly), "merged")
        step = moved.select("from", "bin", "offset")
        if to is None:
            to = step
        else:
            on = step.select(F.col("from").alias("bin"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
            older = to.join(on, "bin", "left").select("from", F.coalesce("_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"))
            to = cut(older.unionByName(step.join(to, "from", "left_anti")), "moves")
        bins = one_each(moved)
    if to is not None:
        by = to.select(F.col("from").alias("bin"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
        placed = placed.join(by, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("_offset", F.lit(0))).withColumn("bin", F.coalesce("_bin", "bin"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.withColumnRenamed("bin", "sequence_id").select(columns).unionByName(whole.select(columns))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", per_part: int = 8_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and is one piece, the closing id 0. Longer documents than capacity are cut. Repeated rows are packed each; null
    ids are kept. An empty table gives an empty result. Other columns are neither read nor returned.
    """
    return pack(cut(pieces(docs, capacity, vocabulary, id_col, text_col), "pieces"), capacity, per_part)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
