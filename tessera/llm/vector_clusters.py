"""Centroid clustering by weighted deduplication: identical quantised vectors are one row with a multiplicity, Lloyd's rounds run over
the distinct vectors with weighted integer sums, and the assignments are joined back to the vec_ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_batches, table
from tessera.llm.vectors import balanced_join, floored_mean, quantised

DIMS, CLUSTERS, ROUNDS = 64, 40, 5
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and its squared distance, in exact integers."""
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for k, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(1)
        nearer = d < best
        best[nearer], cluster[nearer] = d[nearer], k
    return cluster, best


def _matrix(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("vector").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def distinct_vectors(vectors: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Tables of (vec_id, vector) for the rows that count, and of (vector, n) for the distinct vectors: little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = quantised(b.column("embedding"), dims)
            raw = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(own)), pa.array(raw, pa.binary())], ["vec_id", "vector"])

    own = small_batches(vectors.select(F.col("vec_id").cast("long"), "embedding"))
    rows = cut(own.mapInArrow(run, "vec_id long, vector binary"), "quantised")
    return rows, cut(rows.groupBy("vector").agg(F.count("*").alias("n")), "distinct-vectors")


def _round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each task sums its vectors times their multiplicities; a row for each centroid reaches the driver."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, n = _matrix(b, dims), b.column("n").to_numpy()
            cluster, _ = nearest(x, centroids)
            np.add.at(total, cluster, x * n[:, None])
            np.add.at(count, cluster, n)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": used, "n": count[used], **{f"t{j}": total[used, j] for j in range(dims)}})

    schema = "cluster long, n long, " + ", ".join(f"t{j} long" for j in range(dims))
    rows = distinct.mapInArrow(sums, schema).groupBy("cluster").agg(F.sum("n"), *[F.sum(f"t{j}") for j in range(dims)]).collect()
    total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for cluster, n, *t in rows:
        total[cluster], count[cluster] = t, n
    return floored_mean(total, count, centroids)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2", dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of vectors (vec_id, embedding).

    The first centroids are the vectors whose sha256 of "seed:vec_id" is smallest. Rows whose vector is null, has another number of
    components than `dims`, or a null, non-finite or immense (over 65536) one, are dropped, and so are over-long lists. Fewer rows than
    clusters give as many centroids as rows; no rows an empty result. A null vec_id has no hash and starts no centroid, unless all are
    null; rows that share a vec_id start in the order of their components. Repeated rows are kept and count each. Other columns are
    ignored. Sums beyond a long are null. What is written to the shared folder is read again after a loss."""
    spark = vectors.sparkSession
    rows, distinct = distinct_vectors(vectors, dims)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("vector", draw.alias("h"), F.hex("vector").alias("x")).orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], _OUT)
    centroids = np.frombuffer(b"".join(bytes(r["vector"]) for r in first), "<i4").reshape(-1, dims).astype(np.int64)
    for _ in range(rounds):
        centroids = _round(distinct, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = nearest(_matrix(b, dims), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vector"), b.column("n"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vector", "n", "cluster", "distance"])

    assigned = cut(distinct.mapInArrow(run, "vector binary, n long, cluster int, distance long"), "assigned")
    inertia = assigned.groupBy("cluster").agg(F.try_sum(F.try_multiply("n", "distance")).alias("cluster_inertia")).collect()
    sums = [r["cluster_inertia"] for r in inertia]
    total = None if None in sums or sum(sums) >= 1 << 63 else sum(sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, digest[r["cluster"]]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = balanced_join(rows, assigned.drop("n"), "vector", distinct, F.col("vec_id"))
    return joined.join(F.broadcast(about), "cluster").select(*[c.split()[0] for c in _OUT.split(", ")])  # a row for each centroid


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings in 40 clusters, five rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Each round as two steps: the nearest centroid of each row, and the centroids' floored means."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT rid, (min((d, c)))[2] AS c, (min((d, c)))[1] AS d
  FROM (SELECT rid, c, list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT d FROM kept v, m{r} m) GROUP BY 1)"""
    update = """
m{s} AS MATERIALIZED (
  SELECT c, coalesce(f, q) q FROM m{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) f
    FROM (SELECT c, j, sum(q[j])::BIGINT s, count(*) n FROM a{r} JOIN kept USING (rid), range(1, 65) t(j) GROUP BY ALL) GROUP BY 1) USING (c))"""
    steps = []
    for r in range(ROUNDS):
        steps += [assign.format(r=r), update.format(r=r, s=r + 1)]
    steps.append(assign.format(r=ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM kept ORDER BY c LIMIT 40),
{", ".join(steps)}
SELECT vec_id, a.c::INT "cluster", d distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT cluster_inertia, (sum(d) OVER ())::BIGINT inertia,
  sha256(array_to_string(m.q, ',')) centroid_sha256
FROM a{ROUNDS} a JOIN m{ROUNDS} m USING (c) JOIN kept USING (rid)"""


ORACLE = _oracle()
