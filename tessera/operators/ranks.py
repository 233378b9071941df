"""Exact ranks and running totals whose keys may hold any share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a round of refinement.
CELLS = 4096
#: The most open ranks that are sent to every task; more are joined by shuffles.
SMALL = 100_000


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """The cell of a value between finite bounds: monotone in the value; halves are taken first, so that the width stays finite."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    inside = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
    return F.when(v == low, 0).when(v == high, cells - 1).otherwise(inside)


def nearest_ranks(df: DataFrame, label: str, value: str, fractions: list[float], stage: Callable[[DataFrame], DataFrame], cells: int = CELLS) -> DataFrame:
    """label, fraction and value: the value of each label at place ceil(fraction * n), at least 1, of its sorted values.

    Rounds of refinement: the range that holds a rank is cut into cells, the rows of each cell are counted where they lie, and the range
    becomes the least and the largest value of the cell that holds the rank, until they are equal. So a task sees `cells` counts of a
    label at most, never its values; a value that many rows share is one range at once. Values are compared as doubles; nulls are left
    out; infinities and NaN, which come last, have cells of their own. Null labels are one label. stage writes a table and reads it back."""
    own = df.select(F.col(label).alias("_label"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    finite = ~F.isnan("v") & (F.abs("v") != float("inf"))
    counts = own.groupBy("_label").agg(F.count("*").alias("n"), F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high"))
    rank = lambda p: F.struct(F.lit(float(p)).alias("fraction"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(p)))).cast("long").alias("rank"))
    state = counts.select("_label", "low", "high", F.explode(F.array(*map(rank, fractions))).alias("r")).select("_label", "r.*", "low", "high", F.lit(None).cast("double").alias("found"))
    state, done = stage(state), None
    first = True
    while True:
        ended = state.where(F.col("found").isNotNull())
        done = ended if done is None else done.unionByName(ended)
        live = state.where(F.col("found").isNull())
        n = live.count()
        if not n:
            return done.select(F.col("_label").alias(label), "fraction", F.col("found").alias("value"))
        # Labels meet as text with a mark, so that null ones do too.
        key = F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit(""))
        bounds = live.select(key.alias("_key"), "_label", "fraction", "rank", "low", "high")
        bounds = F.broadcast(bounds) if n <= SMALL else bounds
        met = own.withColumn("_key", key).drop("_label").join(bounds, "_key")
        v, low, high = F.col("v"), F.col("low"), F.col("high")
        if first:
            cell = F.when(F.isnan(v), cells + 1).when(v == float("inf"), cells).when(v == float("-inf"), -1).otherwise(_cell(v, low, high, cells))
        else:
            met, cell = met.where((v >= low) & (v <= high)), _cell(v, low, high, cells)
        counted = met.groupBy("_label", "fraction", "rank", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("_label", "fraction").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        at = counted.withColumn("before", before).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
        over = F.isnan("low") | (F.col("low") == F.col("high"))
        state = stage(at.select("_label", "fraction", (F.col("rank") - F.col("before")).alias("rank"), "low", "high", F.when(over, F.col("low")).alias("found")))
        first = False


def running_totals(df: DataFrame, key: str, order: list[str], value: str, name: str, stage: Callable[[DataFrame], DataFrame], parts: int | None = None) -> DataFrame:
    """Adds the sum of the values of a key's rows that come before each row in an order (0 for the first), for keys of any size.

    Rows are dealt to ranges of (key, order), so that a key takes as many parts as its rows need, and are summed within a part. Only the
    first key of a part can begin before it, so what earlier parts add is one row a part. Rows that are equal in the order are taken in
    any, but fixed, sequence; null keys are a key; null values count as 0. stage writes a table and reads it back."""
    by = [F.col(key), *map(F.col, order)]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = stage(dealt.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    amount = F.coalesce(F.col(value), F.lit(0))
    within = F.sum(amount).over(Window.partitionBy("_part", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - amount
    totals = placed.groupBy("_part", key).agg(F.sum(amount).alias("_total"))
    # A key's rows lie in parts that follow each other: each part's sum is one row, whatever it holds.
    earlier = F.sum("_total").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.withColumn("_before", earlier).where(F.col("_before").isNotNull()).select("_part", F.col(key).alias("_key"), "_before")
    joined = placed.withColumn("_within", within).join(F.broadcast(carried), ["_part"], "left")  # at most one row a part
    return joined.withColumn(name, F.col("_within") + F.when(F.col("_key").eqNullSafe(F.col(key)), F.coalesce("_before", F.lit(0))).otherwise(0)).drop("_part", "_at", "_within", "_key", "_before")
