"""Releases in catalog tables: one partition a release, replaced alone, seen once it is marked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.statements import query

KEY = "release_id"


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != KEY)


def create_release_table(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None) -> None:
    """A table of these columns with a partition for each release, and the table of its markers, where there are none of these names; tables
    that are there stay as they are. location: a folder for both, else the warehouse."""
    at = lambda x: "" if location is None else f" LOCATION '{location.rstrip('/')}/{x}'"
    query(spark, f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:t) ({_columns(schema)}, {KEY} string) USING parquet PARTITIONED BY ({KEY}){at('rows')}", t=name)
    query(spark, f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:t) ({KEY} string, released_at timestamp) USING parquet{at('markers')}", t=f"{name}_releases")


def load_release(df: DataFrame, name: str, release: str) -> int:
    """Writes the rows of a release in place of what that release held before; other releases stay. Its marker comes last, so that readers
    see it whole. The columns are matched by name, and missing or extra ones are an error. Returns the rows that can be read back."""
    spark = df.sparkSession
    wanted = [c for c in spark.table(name).columns if c != KEY]
    if set(df.columns) - {KEY} != set(wanted):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(wanted))}")
    names = ", ".join(f"`{c}`" for c in wanted)
    view = f"release_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        query(spark, f"INSERT OVERWRITE TABLE IDENTIFIER(:t) PARTITION ({KEY} = {_literal(release)}) SELECT {names} FROM {view}", t=name)
    finally:
        spark.catalog.dropTempView(view)
    spark.createDataFrame([(release,)], f"{KEY} string").select(KEY, F.current_timestamp().alias("released_at")).write.mode("append").insertInto(f"{name}_releases")
    return spark.table(name).where(F.col(KEY) == release).count()


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def latest_release(spark: SparkSession, name: str) -> str | None:
    row = spark.table(f"{name}_releases").orderBy(F.col("released_at").desc(), F.col(KEY).desc()).first()
    return row[KEY] if row else None


def release_rows(spark: SparkSession, name: str, release: str | None = None) -> DataFrame:
    """The rows of a release, or of the latest that is marked, by a filter on the partitions: folders of other releases are not listed."""
    release = latest_release(spark, name) if release is None else release
    return spark.table(name).where(F.col(KEY) == F.lit(release))
