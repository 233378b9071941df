"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words (fixed values, as a Java and Python character class).
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A session on one machine gets a fresh one where none is configured; on a cluster
    that is an error, since executors cannot see each other's local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_own: ContextVar[list[DataFrame] | None] = ContextVar("own", default=None)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    if (own := _own.get()) is not None:
        own.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut wrote, once all that was read from them has been written too."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that cut writes in this block and thread, at its end or when it fails: the block must have written what it read
    from them. What shall stay is taken out of the list that the block gets; the last entry is the table written last."""
    own: list[DataFrame] = []
    token = _own.set(own)
    try:
        yield own
    finally:
        _own.reset(token)
        discard(*own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the batches that its session hands to Python are set to at most 1000 rows: whole texts are wide rows."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        df.sparkSession.conf.set(key, str(most))
    return df


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_parts(rows: int, per_part: int) -> int:
    """How many parts hold `rows` rows with about `per_part` in each."""
    return max(1, -(-rows // per_part))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, spread: Column, how: str = "inner") -> DataFrame:
    """A join whose left side may have one key in a third of its rows: `spread` deals such rows to `salts` parts, and the right side,
    with few rows a key, is repeated for each part. how: inner, left, left_semi or left_anti."""
    a = left.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")
