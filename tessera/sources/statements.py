"""Statements over registered tables, with bound parameters."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T


def query(spark: SparkSession, text: str, **binds) -> DataFrame:
    """The rows of a statement; :name in it stands for the parameter of that name, which is never spliced into the text."""
    return spark.sql(text, args=binds)


def small_result(df: DataFrame, seconds: float = 120, most: int = 10_000) -> list[Row]:
    """The rows of a statement that answers a request: at most `most`, more are an error. Its jobs are cancelled after `seconds`."""
    context, tag, late = df.sparkSession.sparkContext, f"statement-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        rows = df.limit(most + 1).collect()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def create_if_absent(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """An empty table of this schema where there is none of this name; one that is there stays as it is."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(name)


def slide_row(spark: SparkSession, table: str, image_id: str, patient_id: str | None = None) -> DataFrame:
    """At most one row of stored slide metadata, of one patient or of the first."""
    scope = "" if patient_id is None else " AND patient_id = :patient"
    binds = {"table": table, "image": image_id} | ({} if patient_id is None else {"patient": patient_id})
    text = f"SELECT image_id, stain_name, stain_group, magnification, file_size_bytes FROM IDENTIFIER(:table) WHERE image_id = :image{scope} ORDER BY patient_id LIMIT 1"
    return query(spark, text, **binds)
