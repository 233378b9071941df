"""Connected components of a graph that is far larger than a task: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, salted_join

SALTS = 8


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # A node that stands for a large group has very many neighbours: its edges are dealt to parts, and its one row of `least` to each.
    return salted_join(both, least, ["u"], SALTS, F.xxhash64("v")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(down, least, ["u"], SALTS, F.xxhash64("v")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v: long) but the roots; root is the smallest node of the component.

    A round keeps components and makes trees flatter, in some log(n)**2 rounds at most; the rounds end when every edge points from a node
    to a root that points nowhere. Each round is written to the shared folder, so the lineage stays short. Loops and repeated edges
    count for nothing; no edges give no rows.
    """
    now = cut(edges.select("u", "v").where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        state = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("k")).first()
        if state["n"] == 0 or (state["n"] == state["k"] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, now = now, cut(_small_star(_large_star(now)), "edges")
        discard(before)
