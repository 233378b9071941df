"""Operators that several plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import staged


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; Spark limits each partition's groups before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") == 1).drop("_rank")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of source in place of those with the same keys; source has each key once."""
    return target.join(source.select(keys), keys, "left_anti").unionByName(source)


def missing(required: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The required keys that are not known."""
    return required.select(keys).distinct().join(known.select(keys), keys, "left_anti")


def appended_counts(rows: DataFrame, counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the counts of their key, 0 where there are none; an error where a column is there already."""
    if clash := set(columns) & set(rows.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    return rows.join(counts.select(key, *columns), key, "left").na.fill(0, columns)


def ranked(df: DataFrame, order: list[Column], stage: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """Adds rank (long, from 0) in an order.

    Ranks come from the sorted range partitions' row counts, so no task sees all rows. The sorted rows are written as a table, since
    both passes must see the same partitions; stage says how."""
    sorted_ = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33)))
    counts = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))  # one row a partition
    return sorted_.join(F.broadcast(starts), "_p").withColumn("rank", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def contiguous_shards(df: DataFrame, order: list[Column], per_shard: int, most: int) -> DataFrame:
    """shard (from 0): runs of equal length in an order, at least per_shard rows each, in at most `most` shards. The rows are counted where
    their ranks lie, so df is evaluated once."""
    placed = ranked(df, order)
    n = (placed.agg(F.max("rank")).first()[0] or 0) + 1
    shards = max(1, min(most, -(-n // per_shard)))
    size = max(1, -(-n // shards))
    return placed.withColumn("shard", F.floor(F.col("rank") / size).cast("int")).drop("rank")


def round_robin_shards(df: DataFrame, order: list[Column], tasks: int) -> DataFrame:
    """shard (from 0): every tasks-th row in an order."""
    if tasks < 1:
        raise ValueError("there must be a task")
    return ranked(df, order).withColumn("shard", F.pmod(F.col("rank"), F.lit(tasks)).cast("int")).drop("rank")
