"""Suffix-array dedup: bytes of long strings that occur elsewhere are found by longest-previous-factor arrays and removed.

Every window of LENGTH bytes has one owner, the least hash among its grams (the leftmost on ties). Equal windows have equal owners at the
same place, so the windows that an owner has in a row make a segment, and segments need to be compared only with those of the same gram.
A segment that occurs twice as a whole is repeated: counting equal segments stands in for the arrays there, since all its windows have
the same earlier match. The others whose gram occurs again, near the ends of a repeated passage, go to suffix arrays, a bounded batch of
grams in each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, hash_parts, small_batches, table, text_or_empty
from tessera.llm.near_dedup import _powers, mix

LENGTH, GRAM = 400, 100
_CHUNK = 1 << 19
_U = np.uint64


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: running minima from both ends of blocks of that width."""
    n = len(v) - width + 1
    full = -(-len(v) // width) * width
    p = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    p[: len(v)] = v
    p = p.reshape(-1, width)
    before = np.minimum.accumulate(p, 1).ravel()
    after = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, segment hash, first window, last window, owner's place) arrays, for a bounded part of the text at a time."""
    whole = np.frombuffer(raw, np.uint8)
    for base in range(0, max(0, len(whole) - length + 1), _CHUNK):
        b = whole[base : base + _CHUNK + length - 1]
        power, inverse = _powers(len(b) + 1)
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + _U(1)) * power[: len(b)], out=run[1:])
        g = mix((run[gram:] - run[:-gram]) * inverse[: len(b) - gram + 1])
        places = np.arange(len(g), dtype=np.uint64)
        low = _U((1 << 23) - 1)
        owner = _least((g & ~low) | places, length - gram + 1) & low
        first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(owner) - 1]])
        at = owner[first].astype(np.int64)
        end = last + length
        own = mix((run[end] - run[first]) * inverse[first] + (end - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (at - first).astype(np.uint64))
        yield g[at].view(np.int64), own.view(np.int64), first + base, last + base, at + base


def _segment_rows(length: int, gram: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, size = [], 0
            for doc, row, text in zip(b["doc_id"], b["_row"], b["text"]):
                for g, own, first, last, at in segments(text.encode("utf-8", "surrogatepass"), length, gram):
                    parts.append((g, own, np.full(len(g), row), np.full(len(g), doc), first, last, at))
                    size += len(g)
                    if size > 200_000:
                        yield _frame(parts)
                        parts, size = [], 0
            if parts:
                yield _frame(parts)

    return rows


def _frame(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("gram", "own", "_row", "_doc", "first", "last", "at"), zip(*parts))})


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the strings of 4, 8, 16 ... symbols at each place, up to those that tell all suffixes apart.

    symbols: bytes, with one place behind each text that holds no byte of it; ends: that place for each place. Strings that reach it are
    equal to no other, so no rank compares bytes of one text with those of the next. Ranks of strings come from pairs of ranks of half as many.
    """
    n = len(symbols)
    here = np.arange(n)
    padded = np.concatenate([np.where(here < ends, symbols + _U(1), _U(0)), np.zeros(4, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = key * _U(257) + np.where(here + k < ends, padded[k : n + k], _U(0))
    of = np.cumsum(here == ends) - (here == ends)
    key = (key << _U(30)) | np.where(here + 4 > ends, of + 1, 0).astype(np.uint64)
    found, rank = np.unique(key, return_inverse=True)
    levels = [rank.astype(np.int32)]
    while len(found) < n:
        step = 4 << (len(levels) - 1)
        then = np.zeros(n, np.int64)
        then[: max(0, n - step)] = levels[-1][step:] + np.int64(1)
        found, rank = np.unique(levels[-1].astype(np.int64) * (n + 2) + then, return_inverse=True)
        levels.append(rank.astype(np.int32))
    return levels


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest smaller one before it, or -1.

    From the least entries of blocks of 1, 2, 4 ...: a search climbs until the block on its left has a smaller entry and goes down to the
    last such one, so its steps are logarithmic for any order of entries.
    """
    least = [v]
    while len(least[-1]) > 1:
        even = np.append(least[-1], np.iinfo(v.dtype).max) if len(least[-1]) % 2 else least[-1]
        least.append(even.reshape(-1, 2).min(1))
    out = np.full(len(v), -1)
    who = node = np.arange(len(v))
    for k, low in enumerate(least[:-1]):
        hit = (node & 1 == 1) & (low[np.maximum(node - 1, 0)] < v[who])
        at = node[hit] - 1
        for below in reversed(least[:k]):
            at = 2 * at + (below[2 * at + 1] < v[who[hit]])
        out[who[hit]] = at
        who, node = who[~hit], node[~hit] >> 1
    return out


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest smaller one after it, or -1."""
    back = previous_smaller(v[::-1])[::-1]
    return np.where(back < 0, -1, len(v) - 1 - back)


def common_lengths(levels: list[np.ndarray], symbols: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at x and at y have in common: the longest ranked strings first, then single symbols."""
    n, shared = len(symbols), np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x + shared, y + shared
        inside = (i < n) & (j < n)
        shared += np.where(inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]), 4 << k, 0)
    for _ in range(3):
        i, j = x + shared, y + shared
        shared += (i < ends[x]) & (j < ends[y]) & (symbols[np.minimum(i, n - 1)] == symbols[np.minimum(j, n - 1)])
    return shared


def previous_factors(symbols: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array over `starts` (ascending): the index of the earlier start that agrees longest with each start (-1
    if there is none), and the length of what they share. symbols and ends are those of suffix_ranks.

    In suffix order, the suffixes that agree longest with one of those before it in the text are the nearest on both sides with a smaller place.
    """
    levels = suffix_ranks(symbols, ends)
    order = np.argsort(levels[-1][starts], kind="stable")
    source, length = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    for near in (previous_smaller(order), next_smaller(order)):
        has = near >= 0
        x, y = order[has], order[near[has]]
        shared = common_lengths(levels, symbols, ends, starts[x], starts[y])
        longer = shared > length[x]
        source[x[longer]], length[x[longer]] = y[longer], shared[longer]
    return source, length


def _repeated(length: int, keep_first: bool):
    def find(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_doc", "_row", "first"], kind="stable").reset_index(drop=True)
        size = g["bytes"].str.len().to_numpy()
        symbols = np.frombuffer(b"".join(x + b"\0" for x in g["bytes"]), np.uint8)
        end = np.cumsum(size + 1) - 1
        base, windows = end - size, size - length + 1
        of = np.repeat(np.arange(len(g)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        source, factor = previous_factors(symbols.astype(np.uint64), np.repeat(end, size + 1), at + base[of])
        later = factor >= length
        reach = np.where(later, factor, 0)
        if not keep_first:
            np.maximum.at(reach, source[later], factor[later])
        marked = reach > 0
        at, of, stop = at[marked], of[marked], (at + reach)[marked]
        if not len(at):
            return pd.DataFrame({"_doc": [], "_row": [], "a": [], "b": []}, dtype="int64")
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)]))
        row, first = g.loc[of[new]], g["first"].to_numpy()[of[new]]
        return pd.DataFrame({"_doc": row["_doc"].to_numpy(), "_row": row["_row"].to_numpy(), "a": first + at[new], "b": first + np.maximum.reduceat(stop, new)})

    return find


SPAN = ["_doc", "_row", "a", "b"]


def _by_factors(pieces: DataFrame, key: str, length: int, keep_first: bool, batch_bytes: int) -> DataFrame:
    """Spans of what repeats within the pieces of each key, keys being dealt to batches of about batch_bytes."""
    total = pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bins = F.pmod(F.xxhash64(key), F.lit(hash_parts(total, batch_bytes))).alias("bin")
    batches = pieces.select(bins, "_doc", "_row", "first", "bytes").groupBy("bin")
    return batches.applyInPandas(_repeated(length, keep_first), "_doc long, _row long, a long, b long")


def _later(r: str, keep_first: bool, at: str = "first"):
    """Which of equal strings are marked: all, or all but the first, r."""
    return (F.col(f"{r}._doc") != F.col("_doc")) | (F.col(f"{r}._row") != F.col("_row")) | (F.col(f"{r}.{at}") != F.col(at)) if keep_first else F.lit(True)


def _crowded(many: DataFrame, length: int, keep_first: bool, most: int, batch_bytes: int, width: int = 25) -> DataFrame:
    """The same for grams with very many different segments, by narrower segments: `width` neighbouring windows share a core of
    length - width + 1 bytes, so equal windows lie in parts of equal cores. Equal parts are counted, the different parts of a core go to
    the arrays, and where a core has more than `most` of them, their single windows are counted by hashes."""
    part = many.withColumn("part", F.explode(F.sequence(F.floor((F.col("at") - F.col("last")) / width), F.floor((F.col("at") - F.col("first")) / width))))
    # The windows of a part start from at - part * width - width + 1 to at - part * width, so far as the segment has them.
    core = F.col("at") - F.col("part") * width
    part = part.withColumn("low", F.greatest("first", core - (width - 1))).withColumn("high", F.least("last", core)).withColumn("_core", core)
    part = part.select(
        "_doc", "_row", F.xxhash64("gram", "part", F.expr(f"substring(bytes, int(_core - first) + 1, {length - width + 1})")).alias("core"), F.col("low").alias("first"),
        "high", F.expr(f"substring(bytes, int(low - first) + 1, int(high - low) + {length})").alias("bytes"), (F.col("_core") - F.col("low")).alias("lead"),
    )
    part = cut(part.withColumn("own", F.xxhash64("core", "lead", "bytes")), "parts")
    each = part.groupBy("core", "own").agg(F.count("*").alias("n"), F.min(F.struct("_doc", "_row", "first")).alias("r"))
    sized = cut(each.join(each.groupBy("core").agg(F.count("*").alias("k")), "core").where((F.col("n") > 1) | (F.col("k") > 1)), "part-counts")
    met = cut(part.join(sized, ["core", "own"]), "parts-met")
    discard(part, sized)
    whole = met.where((F.col("n") > 1) & _later("r", keep_first)).select("_doc", "_row", F.col("first").alias("a"), (F.col("high") + length).alias("b"))
    apart = met.where((F.col("k") > 1) & ~_later("r", True))
    out = whole.unionByName(_by_factors(apart.where(F.col("k") <= most), "core", length, keep_first, batch_bytes))
    window = apart.where(F.col("k") > most).select("_doc", "_row", "core", "first", "bytes", F.explode(F.sequence("first", "high")).alias("w"))
    keyed = window.select("_doc", "_row", "w", F.xxhash64(F.expr(f"substring(bytes, int(w - first) + 1, {length})"), "core").alias("h"))
    count = keyed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("_doc", "_row", "w")).alias("r")).where(F.col("n") > 1)
    more = keyed.join(count, "h").where(_later("r", keep_first, "w"))
    return out.unionByName(more.select("_doc", "_row", F.col("w").alias("a"), (F.col("w") + length).alias("b")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, most: int = 1_000, batch_bytes: int = 1_500_000) -> DataFrame:
    """(_doc, _row, a, b): byte ranges of texts that are covered by repeated strings of `length` bytes; they may overlap.

    docs: _row (equal for repeated rows), doc_id, text; the two together tell texts apart. keep_first leaves the first occurrence, by doc_id
    and place, unmarked. A task collects a batch of grams with at most `most` different segments each; for the others see _crowded.
    """
    seg = cut(docs.mapInPandas(_segment_rows(length, gram), "gram long, own long, _row long, _doc long, first long, last long, at long"), "segments")
    each = cut(seg.groupBy("gram", "own").agg(F.count("*").alias("n"), F.min(F.struct("_doc", "_row", "first", "last", "at")).alias("r")), "segment-counts")
    hit = seg.join(each.where(F.col("n") > 1).select("gram", "own", "r"), ["gram", "own"]).where(_later("r", keep_first))
    # A table of its own, so that adaptive execution can split the keys of much copied segments; copies of a row share a _row.
    spans = cut(hit.select("_doc", "_row", F.col("first").alias("a"), (F.col("last") + length).alias("b")), "whole-segments")
    several = each.groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > 1)
    open_ = each.join(several, "gram").select("gram", "k", "r._row", "r._doc", "r.first", "r.last", "r.at")
    lists = open_.groupBy("_doc", "_row").agg(F.collect_list(F.struct("gram", "k", "first", "last", "at")).alias("s"))
    raw = docs.select(F.col("doc_id").alias("_doc"), "_row", F.col("text").cast("binary").alias("_b")).join(lists, ["_doc", "_row"])
    cutting = raw.select("_doc", "_row", "_b", F.explode("s").alias("s")).select(
        "_doc", "_row", "s.*", F.expr(f"substring(_b, int(s.first) + 1, int(s.last - s.first) + {length})").alias("bytes")
    )
    # Repeated rows give their segments twice. Those are marked above already, unless the first one is to stay.
    pieces = cut(cutting.dropDuplicates(["_doc", "_row", "first"]) if keep_first else cutting, "contested")
    discard(seg, each)
    out = spans.unionByName(_by_factors(pieces.where(F.col("k") <= most), "gram", length, keep_first, batch_bytes))
    many = pieces.where(F.col("k") > most)
    return out if many.isEmpty() else out.unionByName(_crowded(many, length, keep_first, most, batch_bytes))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in batches:
        rows = []
        for doc, text, a, b in zip(g["doc_id"], g["text"], g["a"], g["b"]):
            raw = text.encode("utf-8", "surrogatepass")
            gone = merged(list(zip(a, b))) if a is not None else []
            edges = [0, *(x for s in gone for x in s), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])) if gone else raw
            left = kept.decode("utf-8", "ignore") if gone else text
            rows.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), left, [int(x) for x in edges[1:-1]]))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans"]).astype({"doc_id": "Int64"})


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", most: int = 1_000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what remains; bytes of a character that is cut in
    two are left out of it, not of the hash), spans (starts and ends of the removed runs, in turn).

    A null text is empty, and texts under `length` bytes lose nothing. Repeated rows are two texts with the same bytes, so with
    keep_first=False both lose all that reaches `length`; with keep_first=True repeated rows count as one text. Null ids are kept.
    Long texts are read whole, in parts of half a million windows that share their edges. Equal strings are ordered by id, then by place.
    Empty tables give empty results. Other columns are neither read nor returned.
    """
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("_row", F.xxhash64("doc_id", "text"))
    source = own.select("_row", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text")
    spans = repeated_spans(source, length, gram, keep_first, most).groupBy("_doc", "_row").agg(F.collect_set(F.struct("a", "b")).alias("s"))
    both = own.withColumn("_doc", F.coalesce("doc_id", F.lit(-1))).join(spans, ["_doc", "_row"], "left").select("doc_id", "text", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    return both.mapInPandas(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, spans array<long>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each document and what remains of its text. Most bytes go by counts of equal segments; the arrays decide the segments
    at the ends of repeated passages."""
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


#: DuckDB SQL for the rows of op10: all windows by their MD5, over hexadecimal texts, in parts of 256 windows; what remains is read as
#: text without the bytes of characters that are cut in two.
ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT r, n, c, substr(h, 2 * c + 1, 2 * (256 + 399)) AS h FROM (SELECT r, n, h, unnest(range(0, n - 399, 256)) AS c FROM t WHERE n >= 400)
), w AS (
  SELECT r, c + j AS i, md5_number(substr(h, 2 * j + 1, 800)) AS k FROM (SELECT r, c, h, unnest(range(least(256, n - 399 - c))) AS j FROM part)
), again AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), mark AS (
  SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true) AS new FROM w SEMI JOIN again USING (k)
), run AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY r ORDER BY i) AS s FROM mark) GROUP BY r, s
), gone AS (
  SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY r
), kept AS (
  SELECT doc_id, x, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda k: h[CASE k WHEN 1 THEN 1 ELSE 2 * b[k - 1] + 1 END : CASE k WHEN n_spans + 1 THEN 2 * n ELSE 2 * a[k] END]), '') END AS rest
  FROM t LEFT JOIN gone USING (r)
)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256,
  CASE n_removed WHEN 0 THEN x ELSE decode(unhex(array_to_string(regexp_extract_all(rest,
    '((?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|(?:E0[AB]|E[1-9ABCEF][89AB]|ED[89]).[89AB].|(?:F0[9AB]|F[123][89AB]|F48).[89AB].[89AB].)+)|..', 1), ''))) END AS text
FROM kept
"""
