"""A stored, sorted index of ids for case-insensitive prefix search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files

SCOPE = ["study_id", "resource_type"]
_IDS = "study_id string, resource_type string, resource_id string, folded string, part int"
_RANGES = "part int, study_id string, resource_type string, low string, high string, n long"


def _casefold(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else x.casefold())


def folded(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the case-folded form of a column. ASCII texts, where that is the lower case, stay in the JVM; others take Unicode's folding,
    which makes ß to ss and İ to i with a dot above."""
    ascii_only = ~F.coalesce(F.col(column), F.lit("")).rlike(r"[^\x00-\x7F]")
    plain, others = df.where(ascii_only).withColumn(name, F.lower(column)), df.where(~ascii_only)
    return plain.unionByName(others.withColumn(name, F.pandas_udf(_casefold, T.StringType())(column)))


def successor(prefix: str) -> str | None:
    """The least text, by code points, above all that start with a prefix; none if there is no such text."""
    for k in range(len(prefix) - 1, -1, -1):
        point = ord(prefix[k])
        if point < 0x10FFFF:
            return prefix[:k] + chr(0xE000 if point == 0xD7FF else point + 1)
    return None


def write_prefix_index(index: DataFrame, path: str, parts: int | None = None) -> None:
    """Publishes index (study_id, resource_type, resource_id) as a new version: distinct ids with their folded form, in ranges of scope and
    folded form that are sorted and lie in folders of their own, and the first and last folded form of each range and scope."""
    spark = index.sparkSession
    rows = folded(index.select(*SCOPE, "resource_id").where(F.col("resource_id").isNotNull()).distinct(), "resource_id", "folded")
    order = [*SCOPE, "folded", "resource_id"]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    version = files.fresh_version()
    out = f"{path.rstrip('/')}/{version}"
    sorted_ = ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sorted_.write.partitionBy("part").option("parquet.block.size", 1 << 20).parquet(f"{out}/ids")
    stored = spark.read.schema(_IDS).parquet(f"{out}/ids")
    stored.groupBy("part", *SCOPE).agg(F.min("folded").alias("low"), F.max("folded").alias("high"), F.count("*").alias("n")).write.parquet(f"{out}/ranges")
    files.set_current_version(spark, path, version)


def _within(column: Column, prefix: str) -> Column:
    end = successor(prefix)
    own = column >= prefix
    return own if end is None else own & (column < end)


def prefix_rows(spark: SparkSession, path: str, study: str, kind: str, text: str) -> DataFrame:
    """The index rows of a study and type whose id has a prefix, ignoring case. The ranges that can hold one are looked up, so other
    folders are not listed, and in those the bounds reach the scan as pushed filters on a sorted column."""
    base, prefix = f"{path.rstrip('/')}/{files.current_version(spark, path)}", text.casefold()
    scope = (F.col("study_id") == study) & (F.col("resource_type") == kind)
    end = successor(prefix)
    meets = (F.col("high") >= prefix) & (F.lit(True) if end is None else F.col("low") < end)
    parts = [r[0] for r in spark.read.schema(_RANGES).parquet(f"{base}/ranges").where(scope & meets).select("part").distinct().collect()]  # ids of ranges only
    rows = spark.read.schema(_IDS).parquet(f"{base}/ids")
    return rows.where(F.col("part").isin(parts) if parts else F.lit(False)).where(scope & _within(F.col("folded"), prefix)).drop("part")


def prefix_suggestions(spark: SparkSession, path: str, study: str, kind: str, text: str, most: int = 8) -> DataFrame:
    """The first ids of a study with a prefix, by folded form, then id."""
    return prefix_rows(spark, path, study, kind, text).orderBy("folded", "resource_id").limit(most).select("resource_id")


def prefix_requests(spark: SparkSession, path: str, requests: DataFrame, most: int = 8) -> DataFrame:
    """study_id, resource_type, text, rank (from 1) and resource_id: the suggestions of many requests (study_id, resource_type, text) at once.

    A row of the index is met by the prefixes of its folded form that were asked for, so the join is one of equal keys: ids are spelled
    out up to the longest text only, and those of a scope without requests not at all. An empty text asks for the first ids of a scope."""
    rows = spark.read.schema(_IDS).parquet(f"{path.rstrip('/')}/{files.current_version(spark, path)}/ids").drop("part")
    asked = folded(requests.select(*SCOPE, "text").where(F.col("text").isNotNull()).distinct(), "text", "prefix")
    longest = asked.groupBy(*SCOPE).agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    spelled = rows.join(longest, SCOPE).withColumn("_k", F.explode(F.filter("_lengths", lambda k: k <= F.length("folded"))))
    keyed = spelled.select(*SCOPE, F.substring(F.col("folded"), F.lit(1), F.col("_k")).alias("prefix"), "folded", "resource_id")
    rank = F.row_number().over(Window.partitionBy(*SCOPE, "prefix").orderBy("folded", "resource_id"))  # limited before the shuffle
    best = keyed.withColumn("rank", rank).where(F.col("rank") <= most)
    return asked.join(best, [*SCOPE, "prefix"]).select(*SCOPE, "text", "rank", "resource_id")
