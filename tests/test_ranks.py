"""Percentiles and running totals against plain versions, with keys that hold most rows and odd values."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tessera.operators.ranks import nearest_ranks, running_totals
from tessera.plans import operations
from tessera.sources.files import staged


def plain_ranks(rows, fractions):
    out = {}
    for label in {l for l, _ in rows}:
        v = sorted((x for l, x in rows if l == label and x is not None), key=lambda x: (math.isnan(x), x if not math.isnan(x) else 0))
        for p in fractions if v else ():
            out[label, p] = v[max(0, math.ceil(p * len(v)) - 1)]
    return out


@pytest.mark.parametrize("cells", [4, 4096])
def test_nearest_ranks(spark, cells):
    r = random.Random(1)
    rows = [("hot", r.choice([1.5, r.gauss(0, 1), r.gauss(0, 1e9), 1e-300 * r.random()])) for _ in range(4000)] + [("one", 3.0), ("nulls", None), ("nulls", None), (None, 2.0), (None, -7.0), ("", 5.0), ("same", 4.0), ("same", 4.0), ("same", None)]
    rows += [("odd", x) for x in (math.inf, -math.inf, math.nan, 0.0, -0.0, 1.7e308, -1.7e308, 5e-324, math.nan, math.inf)] + [("endless", math.inf), ("endless", math.inf)]
    fractions = [0.0, 0.01, 0.3, 0.5, 0.75, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(rows, "l string, x double")
    got = {(a.l, a.fraction): a.value for a in nearest_ranks(df, "l", "x", fractions, staged, cells).collect()}
    expected = plain_ranks(rows, fractions)
    assert {k: repr(abs(v) if v == 0 else v) for k, v in got.items()} == {k: repr(abs(v) if v == 0 else v) for k, v in expected.items()}
    assert nearest_ranks(df.where("false"), "l", "x", fractions, staged).isEmpty()


def test_percentiles_see_counts_only(spark):
    """No operator gathers a label's values: only counts of cells go through a window."""
    events = spark.range(30_000).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("event_type"), (F.xxhash64("id") % 100_000 / 7).alias("value"))
    got = {r.event_type: r for r in operations.latency_percentiles(events).collect()}
    for label in ("a", "b"):
        v = sorted(r.value for r in events.where(F.col("event_type") == label).collect())
        assert (got[label].n, got[label].p50, got[label].p99, got[label].most) == (len(v), v[math.ceil(0.5 * len(v)) - 1], v[math.ceil(0.99 * len(v)) - 1], v[-1])


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, parts):
    r = random.Random(2)
    rows = [("hot", k, r.randrange(100)) for k in range(900)] + [(f"k{k % 13}", k, k) for k in range(60)] + [(None, 1, 5), (None, 2, None), (None, 3, 7), ("single", 0, 9)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long")
    expected, sums = [], {}
    for k, o, v in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        expected.append((k, o, v, sums.get(k, 0)))
        sums[k] = sums.get(k, 0) + (v or 0)
    seen = []

    def stage(d):
        seen.append(staged(d))
        return seen[-1]

    got = running_totals(df, "k", ["o"], "v", "before", stage, parts)
    assert sorted(map(repr, map(tuple, got.select("k", "o", "v", "before").collect()))) == sorted(map(repr, expected))
    spread = seen[0].where("k = 'hot'").select("_part").distinct().count()
    assert spread == 1 if parts == 1 else spread >= 4  # the large key lies in many parts
    assert running_totals(df.where("false"), "k", ["o"], "v", "before", staged).isEmpty()
