"""Service measurements: percentiles, histograms, cache pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import nearest_ranks, running_totals
from tessera.sources.files import staged

BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


def latency_percentiles(events: DataFrame, fractions: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of each label, with the count, the largest value and the mean; labels may hold any share of the rows."""
    ranks = nearest_ranks(events, "event_type", "value", list(fractions), staged)
    columns = [F.max(F.when(F.col("fraction") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in fractions]
    own = events.groupBy("event_type").agg(F.count("value").alias("n"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    wide = ranks.groupBy(F.col("event_type").alias("_label")).agg(*columns)
    return own.join(wide, F.col("event_type").eqNullSafe(F.col("_label")), "left").select("event_type", "n", *[f"p{int(p * 100)}" for p in fractions], "most", "mean")


def metric_histogram(events: DataFrame, bounds: list[float] = BOUNDS) -> DataFrame:
    """Cumulative counts of each label at fixed bounds: one pass of conditional counts, then a row a bound."""
    counted = events.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("value").alias("b_all"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("b_all").alias("n"))]
    return counted.select("event_type", F.explode(F.array(*cells)).alias("c")).select("event_type", "c.le", "c.n")


def cache_entries(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select((key % 16).cast("int").alias("node"), F.concat(F.lit("/cache/"), key.cast("string")).alias("path"), F.col("p_size").cast("long").alias("mtime"), (key * 7919 % 1000 + 1).alias("size"), (key % 17 == 0).alias("locked"))


def cache_prune_plan(entries: DataFrame, share: float = 0.6, low: float = 0.8) -> DataFrame:
    """The entries to delete on each node whose total is above its limit (`share` of its total here): the oldest that are not locked,
    until at most `low` of the limit is left. Locked entries count in the total."""
    totals = entries.groupBy("node").agg(F.sum("size").alias("total"))
    over = totals.withColumn("limit", F.floor(F.col("total") * share)).where(F.col("total") > F.col("limit")).select("node", "total", F.floor(F.col("limit") * low).alias("goal"))
    before = running_totals(entries.where(~F.col("locked")), "node", ["mtime", "size", "path"], "size", "before", staged)
    return before.join(over, "node").where(F.col("total") - F.col("before") > F.col("goal")).select("node", "path", "size")
