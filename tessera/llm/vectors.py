"""Helpers for tables of vectors (vec_id, embedding, label)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest size of a quantised component: sums of squares, and their sums over 10^10 rows of usual sizes, then fit into a long.
LARGEST = 1 << 24


def finite(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch hold `dims` components, none of them null or non-finite, and those rows as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    own = pc.equal(pc.list_value_length(column), dims).fill_null(False).to_numpy(zero_copy_only=False).copy()
    flat = column.filter(pa.array(own)).flatten().cast(pa.float64())
    m = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(m).all(1)
    own[own] = good
    return own, m[good]


def quantised(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """As finite, with each component x as the integer floor(256 * x); rows with one beyond LARGEST do not count either."""
    own, m = finite(column, dims)
    with np.errstate(over="ignore"):
        q = np.floor(256 * m)
    good = (np.abs(q) <= LARGEST).all(1)
    own[own] = good
    return own, q[good].astype(np.int64)


def floored_mean(total: np.ndarray, count: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(total / count) by rows of integers; rows without a count keep the old values."""
    return np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], old)


def balanced_join(many: DataFrame, few: DataFrame, key: str, counts: DataFrame, spread: Column, how: str = "inner", shares: int = 1000) -> DataFrame:
    """many joined to few by a key that has no nulls, of which one value may be in a third of the rows of many.

    counts (key, n) tells how often many has each key. Keys with over 1/shares of all rows, which are fewer than `shares`, are dealt to
    parts of at most that size by `spread`, and few is repeated for those keys alone: so what is broadcast has fewer than `shares` rows
    of three small columns, however large the tables are. how: inner or left."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * shares > total).select(key, F.ceil(F.col("n") * shares / total).cast("int").alias("_parts"))
    a = many.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int"))
    b = few.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return a.drop("_parts").join(b.drop("_parts"), [key, "_salt"], how).drop("_salt")
