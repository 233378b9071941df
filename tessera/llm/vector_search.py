"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table's bucket is the k integers floor((a.v + b) / w) with Gaussian a. A query visits buckets near its own in the order of their
estimated success: a neighbour lies beyond a cell's border the likelier the nearer the border is, so buckets that differ by -1, 0 or 1
in each place are visited by the sum of the squared distances to the borders that are crossed, over all tables together. What the
visited buckets hold is measured exactly."""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, small_batches, table
from tessera.llm.vectors import balanced_join, finite

DIMS, NEAREST, EVERY = 64, 10, 100
#: Tables; the most probes of a query, beyond which buckets are made coarser; vectors in a block; queries in a block.
TABLES, PROBES, BLOCK, ASKED = 4, 512, 256, 64
#: Queries whose nearest rows a task holds before it hands them on.
HELD = 10_000
#: Queries of the fit and vectors that stand for all in it (bounds), the share of their neighbours that must be reached, and a cell's width in distances to a neighbour.
FITTED, SAMPLED, REACHED, WIDTH = 128, 64, 0.97, 1.4
_OUT = "query_id long, rank int, vec_id long, score double"


class Hashing:
    """Hash functions of all tables: k places each, cells of width w. Fewer places use the first of the same functions."""

    def __init__(self, dims: int, k: int, width: float, tables: int = TABLES) -> None:
        rng = np.random.default_rng(20250713)
        self.k, self.width, self.tables = k, width, tables
        directions, shifts = rng.standard_normal((tables, 16, dims)), rng.random((tables, 16))
        self.directions, self.shifts = directions[:, :k].reshape(-1, dims), shifts[:, :k].ravel()
        self.mixers = rng.integers(1, 1 << 62, (tables, 16), dtype=np.int64)[:, :k] * 2 + 1
        self.names = rng.integers(1, 1 << 62, tables, dtype=np.int64)
        self.steps = np.array(list(itertools.product((0, -1, 1), repeat=k)), np.int64)

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, k): positions in units of the width."""
        return (x @ self.directions.T / self.width + self.shifts).reshape(len(x), self.tables, self.k)

    @staticmethod
    def cells(places: np.ndarray) -> np.ndarray:
        return np.floor(np.clip(places, -(1 << 61), 1 << 61)).astype(np.int64)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """(rows, tables) keys of cells; they wrap around, so that two buckets may share one, which adds candidates and loses none."""
        return (cells * self.mixers).sum(2) + self.names

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of queries, and (rows, tables * steps) sums of squared distances to the borders crossed by each step."""
        f = self.places(x)
        cells = np.floor(f)
        left = f - cells
        squares = np.stack([np.zeros_like(left), left**2, (1 - left) ** 2], 3)  # by step 0, -1, 1
        total = np.zeros((len(x), self.tables, 1))
        for j in range(self.k):
            total = (total[:, :, :, None] + squares[:, :, j, None, :]).reshape(len(x), self.tables, -1)
        return self.cells(f), total.reshape(len(x), -1)

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """(rows, most) keys of the buckets that each query visits, likeliest first."""
        cells, score = self.scores(x)
        first = np.argsort(score, 1, kind="stable")[:, :most]
        of, step = first // len(self.steps), self.steps[first % len(self.steps)]
        own = np.take_along_axis(cells, of[:, :, None], 1)
        return ((own + step) * self.mixers[of]).sum(2) + self.names[of]

    def ranks(self, x: np.ndarray, which: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many buckets a query (row `which` of x, for each row of others) must visit to meet it; infinite where no step leads there."""
        cells, score = self.scores(x)
        rank = np.empty_like(score)
        np.put_along_axis(rank, np.argsort(score, 1, kind="stable"), np.arange(1.0, score.shape[1] + 1)[None, :], 1)
        gap = self.cells(self.places(others)) - cells[which]
        near = (np.abs(gap) <= 1).all(2)
        step = (np.where(gap == -1, 1, np.where(gap == 1, 2, 0)) * 3 ** np.arange(self.k - 1, -1, -1)).sum(2)
        met = rank.reshape(len(x), self.tables, -1)[which[:, None], np.arange(self.tables), step]
        return np.where(near, met, np.inf).min(1)


def _matrix(raw: list[bytes], kind: str, dims: int) -> np.ndarray:
    """Stored vectors as doubles, which hold every float exactly."""
    return np.frombuffer(b"".join(raw), kind).reshape(-1, dims).astype(np.float64)


def stored_kind(vectors: DataFrame) -> str:
    """How components are stored: as they came, floats or doubles."""
    return "<f4" if getattr(vectors.schema["embedding"].dataType, "elementType", None) == T.FloatType() else "<f8"


def measured(queries: np.ndarray, x: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places of its `most` nearest rows of x, ties at the end included, and their exact distances."""
    estimate = np.maximum((queries**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * queries @ x.T, 0)
    scale = (queries**2).sum(1) + (x**2).sum(1).max()
    for i, e in enumerate(estimate):
        last = np.partition(e, most - 1)[most - 1] if len(e) > most else np.inf
        near = np.flatnonzero(e <= last + 1e-9 * scale[i])  # the estimate is off by less
        yield i, near, np.sqrt(((x[near] - queries[i]) ** 2).sum(1))


def distinct_vectors(vectors: DataFrame, dims: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Tables of the distinct vectors that take part (class: 16 bytes of a digest, ids: their smallest vec_ids, at most `most`, x: as stored_kind says),
    and of the queries (query_id, class). Of equal vectors only so many can be among the nearest, the smallest ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, m = finite(b.column("embedding"), dims)
            some = m.any(1)
            own[own] = some
            raw = [r.tobytes() for r in (m[some] + 0.0).astype(kind)]  # no negative zeros
            classes = [hashlib.sha256(r).digest()[:16] for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(own)), pa.array(classes, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "class", "x"])

    kind = stored_kind(vectors)
    own = small_batches(vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull()))
    rows = cut(own.mapInArrow(run, "vec_id long, class binary, x binary"), "vectors")
    place = F.dense_rank().over(Window.partitionBy("class").orderBy("vec_id"))  # limited in each task before the shuffle
    few = rows.withColumn("_place", place).where(F.col("_place") <= most)
    classes = few.groupBy("class").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("x").alias("x"))
    queries = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "class").distinct()
    return cut(classes, "vector-classes"), cut(queries, "vector-queries")


def fitted(classes: DataFrame, asked: DataFrame, kind: str, dims: int, nearest: int = NEAREST) -> tuple[Hashing, int]:
    """The hash functions and the number of probes, from the true neighbours of at most FITTED of the asked classes.

    Those are found by a pass over all vectors, in blocks. Tried are cells from WIDTH times the median distance to a neighbour on, each 1.3
    times as wide as the last, and places up to a fourth of the binary logarithm of the number of vectors. For each the probes that reach
    REACHED of the neighbours are counted, and of those with at most PROBES the one is taken that visits the smallest share of SAMPLED vectors."""
    sample = asked.orderBy("class").limit(FITTED).collect()
    ids, q = [bytes(r["class"]) for r in sample], _matrix([r["x"] for r in sample], kind, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes, bytes]]] = [[] for _ in ids]
        for b in batches:
            classes, raw = b.column("class").to_pylist(), b.column("x").to_pylist()
            for i, near, d in measured(q, _matrix(raw, kind, dims), nearest + 1):
                best[i] = sorted([*best[i], *((e, classes[j], raw[j]) for j, e in zip(near, d.tolist()) if classes[j] != ids[i])])[:nearest]
        found = [(i, e, c, x) for i, own in enumerate(best) for e, c, x in own]
        yield pa.RecordBatch.from_pydict({"i": pa.array([f[0] for f in found], pa.int32()), "d": pa.array([f[1] for f in found], pa.float64()), "c": pa.array([f[2] for f in found], pa.binary()), "x": pa.array([f[3] for f in found], pa.binary())})

    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "c"))
    found = classes.select("class", "x").mapInArrow(run, "i int, d double, c binary, x binary").withColumn("_place", place).where(F.col("_place") <= nearest).collect()
    if not found:
        return Hashing(dims, 1, 1.0), TABLES
    which, near = np.array([r["i"] for r in found]), _matrix([r["x"] for r in found], kind, dims)
    others = _matrix([r["x"] for r in classes.orderBy("class").select("x").limit(SAMPLED).collect()], kind, dims)
    every = np.repeat(np.arange(len(q)), len(others))
    least, places = WIDTH * float(np.median([r["d"] for r in found])), min(8, max(1, round(math.log2(max(2, classes.count())) / 4)))
    tried = []
    for k, step in itertools.product(range(places, 0, -1), range(16)):
        hashing = Hashing(dims, k, least * 1.3**step)
        need = float(np.quantile(hashing.ranks(q, which, near), REACHED, method="higher"))
        if need <= PROBES:
            tried.append((float((hashing.ranks(q, every, np.tile(others, (len(q), 1))) <= need).mean()), int(need), hashing))
    if not tried:  # distances of many scales: cells that hold everything
        return Hashing(dims, 1, 1e300), TABLES
    _, need, hashing = min(tried, key=lambda t: t[:2])
    return hashing, need


def _blocks(keyed: DataFrame, size: int, carried: str, schema: str) -> DataFrame:
    """Rows (key, x, carried) as blocks of at most `size` rows of one key. The tasks stream through rows that are sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, xs, own = None, [], []
        out: list[tuple] = []

        def flushed(enough: int) -> Iterator[pa.RecordBatch]:
            if len(out) > enough:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], listed)], ["key", "xs", carried])
                out.clear()

        for b in batches:
            for k, x, c in zip(b.column("key").to_pylist(), b.column("x").to_pylist(), b.column(carried).to_pylist()):
                if xs and (k != key or len(xs) == size):
                    out.append((key, b"".join(xs), own))
                    xs, own = [], []
                    yield from flushed(64)
                key = k
                xs.append(x)
                own.append(c)
        if xs:
            out.append((key, b"".join(xs), own))
        yield from flushed(0)

    listed = pa.list_(pa.list_(pa.int64()) if carried == "ids" else pa.binary())
    dealt = keyed.repartition("key", F.pmod(F.xxhash64(carried), F.lit(32))).sortWithinPartitions("key")
    return dealt.mapInArrow(run, schema)


def indexed(classes: DataFrame, hashing: Hashing, kind: str, dims: int) -> DataFrame:
    """The index: blocks (key, xs, ids) of the vectors of each bucket of each table."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys = hashing.keys(hashing.cells(hashing.places(_matrix(part.column("x").to_pylist(), kind, dims))))
                row = pa.array(np.repeat(np.arange(part.num_rows), hashing.tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("x").take(row), part.column("ids").take(row)], ["key", "x", "ids"])

    return cut(_blocks(classes.mapInArrow(spread, "key long, x binary, ids array<long>"), BLOCK, "ids", "key long, xs binary, ids array<array<long>>"), "blocks")


def visited(index: DataFrame, asked: DataFrame, hashing: Hashing, probes: range, kind: str, dims: int, most: int) -> DataFrame:
    """class, score and vec_id: the `most` nearest rows of each query (class, x, limit) in the buckets that it visits by some of its probes,
    of those that are within its limit. Each task merges over the blocks that it measures; pairs of single vectors never leave it."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                keys = hashing.probes(_matrix(part.column("x").to_pylist(), kind, dims), probes.stop)[:, probes.start :]
                row = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                tags = [c + struct.pack("<d", limit) for c, limit in zip(part.column("class").to_pylist(), part.column("limit").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("x").take(row), pa.array(tags, pa.binary()).take(row)], ["key", "x", "tag"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[tuple[float, int]]] = {}

        def merged() -> pa.RecordBatch:
            own = [(c, e, v) for c, found in best.items() for e, v in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.binary()), pa.array([o[1] for o in own], pa.float64()), pa.array([o[2] for o in own], pa.int64())], ["class", "score", "vec_id"])

        for b in batches:
            for left, right, tags, members in zip(b.column("xs").to_pylist(), b.column("qs").to_pylist(), b.column("tag").to_pylist(), b.column("ids").to_pylist()):
                for i, near, d in measured(_matrix([right], kind, dims), _matrix([left], kind, dims), most):
                    name, (last,) = tags[i][:-8], struct.unpack("<d", tags[i][-8:])
                    old = best.get(name, [])
                    last = min(last, old[-1][0]) if len(old) == most else last
                    own = {(e, v) for j, e in zip(near.tolist(), d.tolist()) if e <= last for v in members[j]}
                    if own:
                        best[name] = sorted(own.union(old))[:most]
                if len(best) > HELD:
                    yield merged()
        yield merged()

    seek = _blocks(asked.select("class", "x", "limit").mapInArrow(visit, "key long, x binary, tag binary"), ASKED, "tag", "key long, xs binary, tag array<binary>").withColumnRenamed("xs", "qs")
    counts = index.groupBy("key").agg(F.count("*").alias("n"))
    pairs = balanced_join(index, seek, "key", counts, F.col("xs"))
    return pairs.select("xs", "qs", "tag", "ids").mapInArrow(measure, "class binary, score double, vec_id long")


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """found: the `most` nearest of each class; what several tables have found has one rank, so that equal rows share theirs."""
    place = F.dense_rank().over(Window.partitionBy("class").orderBy("score", "vec_id"))
    few = pairs.withColumn("_place", place).where(F.col("_place") <= most)
    return cut(few.groupBy("class").agg(F.array_sort(F.collect_set(F.struct("score", "vec_id"))).alias("found")), "nearest")


def searched(classes: DataFrame, asked: DataFrame, hashing: Hashing, probes: int, kind: str, dims: int, most: int) -> DataFrame:
    """found of each asked class. The likeliest quarter of the probes comes first; the others then look only for what is no farther than
    the last of the `most` that those have found."""
    index, first = indexed(classes, hashing, kind, dims), max(1, probes // 4)
    near = _best(visited(index, asked.withColumn("limit", F.lit(math.inf)), hashing, range(first), kind, dims, most), most)
    if first == probes:
        return near
    last = F.when(F.size("found") == most, F.element_at("found", -1)["score"])
    limited = asked.join(near, "class", "left").select("class", "x", F.coalesce(last, F.lit(math.inf)).alias("limit"))
    rest = visited(index, limited, hashing, range(first, probes), kind, dims, most)
    return _best(rest.unionByName(near.select("class", F.explode("found").alias("e")).select("class", "e.score", "e.vec_id")), most)


def nearest_neighbours(vectors: DataFrame, dims: int = DIMS, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: the `nearest` rows found for each row whose vec_id is divisible by EVERY, by Euclidean distance
    in double precision, ties by vec_id.

    Rows whose vector is null, zero, of another length than `dims`, or holds null or non-finite components take no part, and neither do
    rows without a vec_id, which could not be named; over-long lists go too. A row is a distinct (vec_id, vector): repeated rows count
    once, and rows that share a vec_id but not the vector are rows of their own, each a query and a candidate of the other. Equal
    vectors share one search. Fewer rows than `nearest` + 1 give all others, an empty table no rows. Other columns are ignored.
    Distances beyond a double are infinite. Tables in the shared folder cut the lineage, so a lost executor costs its tasks only."""
    spark, most = vectors.sparkSession, nearest + 1
    classes, queries = distinct_vectors(vectors, dims, most)
    asked = cut(classes.join(queries.select("class").distinct(), "class", "left_semi"), "asked")
    kind = stored_kind(vectors)
    hashing, probes = fitted(classes, asked, kind, dims, nearest)
    best = searched(classes, asked, hashing, probes, kind, dims, most)
    counts = queries.groupBy("class").agg(F.count("*").alias("n"))
    own = balanced_join(queries, best, "class", counts, F.col("query_id"))
    others = F.slice(F.filter("found", lambda e: ~((e["vec_id"] == F.col("query_id")) & (e["score"] == 0))), 1, nearest)
    return own.select("query_id", F.posexplode(others).alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), "e.vec_id", "e.score")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of embeddings of each of its queries."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
