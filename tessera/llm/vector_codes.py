"""Vector code compression: product quantisation whose nearest entries are found by annular norm pruning.

The entries of a codebook are sorted by norm. As |norm(x) - norm(e)| <= distance(x, e), only entries within the current best distance of
x's own norm can be nearer: two binary searches give that interval, and its entries, both ends included, are evaluated exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_batches, table
from tessera.llm.vectors import balanced_join, floored_mean, quantised

DIMS, PARTS, ENTRIES, ROUNDS, FIRST = 64, 16, 64, 2, 4
_OUT = "vec_id long, label int, code string, error long"


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x (ties: the lower index) and its squared distance. All are integers of at most LARGEST.

    The FIRST entries next to x's norm give the first best distance. Norms are rounded doubles, so the interval is widened by more than
    they can be off; distances are exact integers."""
    norm = np.sqrt((entries * entries).sum(1))
    order = np.argsort(norm, kind="stable")
    norm, ranked = norm[order], entries[order]
    own = np.sqrt((x * x).sum(1))
    at, best = np.searchsorted(norm, own), None
    for step in range(-(FIRST // 2), FIRST - FIRST // 2):
        d = ((x - ranked[np.clip(at + step, 0, len(norm) - 1)]) ** 2).sum(1)
        best = d if best is None else np.minimum(best, d)
    reach = np.sqrt(best) + 1e-9 + 1e-12 * (own + np.sqrt(best))
    low, high = np.searchsorted(norm, own - reach, "left"), np.searchsorted(norm, own + reach, "right")
    width = high - low
    starts = np.cumsum(width) - width
    row = np.repeat(np.arange(len(x)), width)
    place = np.arange(len(row)) - starts[row] + low[row]
    d = ((x[row] - ranked[place]) ** 2).sum(1)
    key = np.minimum.reduceat(d * len(norm) + order[place], starts) if len(x) else np.zeros(0, np.int64)
    return key % len(norm), key // len(norm)


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part of each row, and the row's summed squared distance. books: (parts, entries, width)."""
    found = [nearest(x[:, p * books.shape[2] : (p + 1) * books.shape[2]], books[p]) for p in range(len(books))]
    return np.stack([i for i, _ in found], 1), np.sum([d for _, d in found], 0)


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round. Each task sums what it reads; a row for each part and entry reaches the driver."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            _, x = quantised(b.column("embedding"), parts * width)
            slot = (coded(x, books)[0] + np.arange(parts) * entries).ravel()
            np.add.at(total, slot, x.reshape(-1, width))
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"slot": used, "n": count[used], **{f"t{j}": total[used, j] for j in range(width)}})

    schema = "slot long, n long, " + ", ".join(f"t{j} long" for j in range(width))
    rows = vectors.select("embedding").mapInArrow(sums, schema).groupBy("slot").agg(F.sum("n"), *[F.sum(f"t{j}") for j in range(width)]).collect()
    total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for slot, n, *t in rows:
        total[slot], count[slot] = t, n
    return floored_mean(total, count, books.reshape(-1, width)).reshape(books.shape)


def first_vectors(vectors: DataFrame, most: int, dims: int) -> np.ndarray:
    """The first `most` vectors that count, by vec_id (nulls last), then components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = quantised(b.column("embedding"), dims)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(own)), pa.array(list(x), pa.list_(pa.int64()))], ["vec_id", "x"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x array<long>").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(most).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, dims)


def compressed(vectors: DataFrame, dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of vectors (vec_id, embedding, label).

    Rows whose vector is null, has another number of components than `dims`, or a null, non-finite or immense (over 65536) one, are
    dropped; long lists so go too. Fewer than `entries` rows make shorter codebooks, no rows an empty result. Repeated rows are coded
    each; where they share a vec_id, the books start in the order of their components. A null vec_id comes last there and is coded like
    the others. Null labels are one label. Other columns are ignored. An error beyond a long is null. Lost executors cost the tasks that they ran."""
    spark = vectors.sparkSession
    own = small_batches(vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("int")))
    first = first_vectors(own, entries, dims)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = first.reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _round(own, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = quantised(b.column("embedding"), dims)
            code, error = coded(x, books)
            mask, text = pa.array(kept), [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(mask), b.column("label").filter(mask), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    rows = cut(own.mapInArrow(run, _OUT), "codes").withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = rows.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = cut(sums, "label-errors")
    joined = balanced_join(rows, sums.drop("n"), "_label", sums, F.struct("vec_id", "code"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all rows of embeddings: 16 parts, 64 entries, two rounds."""
    return compressed(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Each round as two steps: the nearest entry of each part, and the entries' floored means."""
    assign = """
n{r} AS MATERIALIZED (
  SELECT rid, p, (min((d, entry)))[2] AS entry, (min((d, entry)))[1] AS d
  FROM (SELECT rid, v.p, entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT d FROM cells v JOIN b{r} b ON v.p = b.p)
  GROUP BY 1, 2)"""
    update = """
b{s} AS MATERIALIZED (
  SELECT p, entry, coalesce(m, x) AS x FROM b{r} LEFT JOIN (
    SELECT p, entry, list(f ORDER BY j) m FROM (
      SELECT p, entry, j, (s - ((s % n) + n) % n) // n AS f
      FROM (SELECT n{r}.p, n{r}.entry, j, sum(x[j])::BIGINT s, count(*) n FROM n{r} JOIN cells USING (rid, p), range(1, 5) t(j) GROUP BY ALL)) GROUP BY 1, 2) USING (p, entry))"""
    steps = []
    for r in range(ROUNDS):
        steps += [assign.format(r=r), update.format(r=r, s=r + 1)]
    steps.append(assign.format(r=ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT rid, p::INT p, q[p * 4 + 1 : p * 4 + 4] x FROM kept, range(0, 16) t(p)),
b0 AS MATERIALIZED (SELECT p, entry, x FROM cells JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, q) - 1 entry FROM kept) USING (rid) WHERE entry < 64),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY p) code, sum(d)::BIGINT error FROM n{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) FROM b{ROUNDS}) codebooks_sha256
FROM coded JOIN kept USING (rid)"""


ORACLE = _oracle()
