"""Vector codes, clusters and search against plain versions, over tables with odd rows."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SF
from tessera.llm import vector_clusters, vector_codes, vector_search, vectors
from tessera.llm.registry import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, class int, key string, ids int, cluster string, slot int, _salt int, _label int"


@pytest.fixture(scope="module")
def odd(spark):
    """Given vectors; nulls, lists of other lengths, nulls and non-finite numbers inside, zeros, an immense one, copies, ids and labels that are null or twice."""
    rng = np.random.default_rng(3)
    given = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY 1 LIMIT 230").fetchall()
    copy = [float(x) for x in given[7][1]]
    rows = [(i + 3, list(v), l) for i, v, l in given]
    rows += [(i, copy, 99) for i in range(1000, 1400)]  # one vector in half of all rows
    rows += [(1500, None, 1), (1501, [], 1), (1502, [0.5] * 63, 1), (1503, [0.5] * 63 + [None], 1), (1504, [math.inf] + [0.1] * 63, None), (1505, [math.nan] * 64, 2), (1506, [0.1] * 6400, 2)]
    rows += [(1600, [0.0] * 64, None), (1700, [-0.0] * 64, None), (1601, [3e38] * 64, 1), (None, copy, None), (None, None, None), (5, copy, 4), (5, copy, 4), (1800, list(given[3][1]), None), (1800, list(given[3][1]), 8)]
    rows += [(2000 + 50 * k, [float(x) for x in np.array(copy) + rng.normal(0, 0.004, 64)], None) for k in range(12)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, "c", 2, "d", 3, 4, 5) for r in rows], SCHEMA)


def kept(rows, most=1 << 24):
    """Quantised rows that count, in the order that starts books."""
    own = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    return sorted([r for r in own if max(map(abs, r[1])) <= most], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows)]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def closest(x, entries):
    return min((distance(x, e), k) for k, e in enumerate(entries))


def test_nearest_by_norm_is_exact():
    rng = np.random.default_rng(1)
    for size, entries in ((3, 64), (40, 1), (1 << 24, 64), (900, 7)):
        e = rng.integers(-size, size + 1, (entries, 4))
        e[entries // 2] = e[0]  # ties
        x = np.concatenate([rng.integers(-size, size + 1, (300, 4)), e, np.zeros((1, 4), np.int64), -e])
        index, d = vector_codes.nearest(x, e)
        assert [(b, a) for a, b in zip(index.tolist(), d.tolist())] == [closest(r, e.tolist()) for r in x.tolist()]


def test_codes(spark, odd):
    rows = kept(odd)
    books = [[r[1][4 * p : 4 * p + 4] for r in rows[:64]] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            own = [[] for _ in books[p]]
            for _, q, _ in rows:
                own[closest(q[4 * p : 4 * p + 4], books[p])[1]].append(q[4 * p : 4 * p + 4])
            books[p] = [mean(o) if o else e for o, e in zip(own, books[p])]
    found = [[closest(q[4 * p : 4 * p + 4], books[p]) for p in range(16)] for _, q, _ in rows]
    errors = Counter()
    for (_, _, l), f in zip(rows, found):
        errors[l] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    expected = [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[l], digest) for (i, _, l), f in zip(rows, found)]
    got = vector_codes.compressed(frame(spark, odd)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("count", [2, 700])
def test_clusters(spark, odd, count):
    rows = kept(odd)[:count]
    ids = {r[0] for r in rows}
    given = [r for r in odd if r[0] in ids]
    rows = kept(given)
    hashed = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [r[1] for r in hashed[:40]]
    for _ in range(5):
        own = [[] for _ in centroids]
        for _, q, _ in rows:
            own[closest(q, centroids)[1]].append(q)
        centroids = [mean(o) if o else c for o, c in zip(own, centroids)]
    found, inertia = [closest(q, centroids) for _, q, _ in rows], Counter()
    for d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    expected = [(r[0], k, d, inertia[k], sum(inertia.values()), digest[k]) for r, (d, k) in zip(rows, found)]
    got = vector_clusters.clustered(frame(spark, given)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


def plain_search(rows, nearest=10):
    own = {(i, tuple(x + 0.0 for x in v)) for i, v, _ in rows if i is not None and v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, m = np.array([i for i, _ in own]), np.array([v for _, v in own])
    out = {}
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((m - m[k]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != k][:nearest]
        out[int(ids[k])] = [(r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return out


def test_search(spark, odd):
    """Equal vectors, near copies and ties come exactly; over all, at least nine of ten neighbours, and each distance is exact."""
    expected, got = plain_search(odd), {}
    for q, rank, v, s in vector_search.nearest_neighbours(frame(spark, odd)).collect():
        got.setdefault(q, []).append((rank, v, s))
    assert {q for q, v in expected.items() if v} == set(got)
    ids = {i: v for i, v, _ in odd if v}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(expected[q]) + 1)) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for _, v, _ in expected[q]})
        assert all(s == pytest.approx(math.dist(ids[q], ids[v]), abs=1e-12) for _, v, s in found if v not in (5, 1800))
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert [v for _, v, _ in got[1000]] == [5, 10, *range(1001, 1009)]  # equal vectors by id, its own left out


def test_search_recall(spark):
    rows = duckdb.sql("SELECT vec_id, embedding, label FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    expected, hits = plain_search(rows), 0
    got = vector_search.op13_vector_search(spark, "/root/testdata/sf0.1").collect()
    for q, rank, v, s in got:
        hits += v in {x for _, x, _ in expected[q]}
    assert len(got) == 10 * len(expected) and hits >= 0.9 * len(got)


def test_probes_follow_the_estimate():
    """Own buckets first; the rank of a neighbour's bucket is the number of probes after which it is visited; keys agree on both sides."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    near = x + rng.normal(size=(40, 8)) * 0.3
    h = vector_search.Hashing(8, 3, 1.5)
    probes, own, theirs = h.probes(x, 10_000), h.keys(h.cells(h.places(x))), h.keys(h.cells(h.places(near)))
    assert probes.shape == (40, 4 * 27) and all(set(p[:4]) == set(o) for p, o in zip(probes.tolist(), own.tolist()))
    for p, t, r in zip(probes.tolist(), theirs.tolist(), h.ranks(x, np.arange(40), near)):
        first = min((p.index(k) + 1 for k in t if k in p), default=math.inf)
        assert first == r


def test_few_and_no_rows(spark, odd):
    for rows in ([], [(100, None, 1)], [(100, [1.0] * 64, 1)]):
        n = len(kept(rows))
        assert vector_codes.compressed(frame(spark, rows)).count() == vector_clusters.clustered(frame(spark, rows)).count() == n
        assert vector_search.nearest_neighbours(frame(spark, rows)).isEmpty()
    rows = [(100, [1.0] * 64, 1), (200, [2.0] * 64, 1), (201, [1.0] * 64, 1)]
    got = sorted(map(tuple, vector_search.nearest_neighbours(frame(spark, rows)).collect()))
    assert got == [(100, 1, 201, 0.0), (100, 2, 200, 8.0), (200, 1, 100, 8.0), (200, 2, 201, 8.0)]


def test_balanced_join(spark):
    many = spark.createDataFrame([("hot" if k % 3 == 0 else f"k{k % 50}", k) for k in range(900)], "key string, at long")
    few = spark.createDataFrame([("hot", 1)] + [(f"k{k}", k) for k in range(0, 50, 2)], "key string, w long")
    counts = many.groupBy("key").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    for shares in (3, 20, 1000):
        for how in ("inner", "left"):
            got = vectors.balanced_join(many, few, "key", counts, many["at"], how, shares)
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, many.join(few, "key", how).select(got.columns).collect())))


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroid_clustering"])
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rel, df = c.sql(ORACLES[name]), QUERIES[name](spark, SF)
    assert sorted(map(tuple, df.select(rel.columns).collect())) == sorted(rel.fetchall())
