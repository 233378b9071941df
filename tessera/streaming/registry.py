"""The thumbnail registry as a stored table that streams of results keep up to date."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.relational import first_by, upsert
from tessera.sources import files

COLUMNS = files.RESULT.fieldNames()


class Registry:
    """One row for each image, in hash buckets of image_id.

    A batch of results reads and writes only the buckets that it touches, beside those that are current; one pointer, which names the
    version of every bucket and each writer's last batch, is then moved in one step. Readers see a batch as a whole or not at all, and a
    batch whose number is not above its writer's last one has been applied before and changes nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def state(self) -> dict:
        stated = files.current_version(self.spark, self.path)
        return json.loads(stated) if stated else {"batches": {}, "buckets": {}}

    def _rows(self, versions: dict[str, str]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], files.RESULT)
        return self.spark.read.schema(files.RESULT).parquet(*[f"{self.path}/{v}/bucket={b}" for b, v in sorted(versions.items())])

    def rows(self) -> DataFrame:
        return self._rows(self.state()["buckets"])

    def apply(self, results: DataFrame, batch: int, writer: str = "batch") -> dict[str, int]:
        """Puts results (columns of COLUMNS, missing ones as null) in place of the rows of their images, and returns how many of them succeeded
        and failed. Of several results of an image in a batch the latest counts, then a success, then the least path and status.
        Results without an image go; null times come before all others."""
        state = self.state()
        if batch <= state["batches"].get(writer, -1):
            return {"record_count": 0, "success_count": 0, "failure_count": 0}
        named = results.where(F.coalesce(F.trim("image_id"), F.lit("")) != "").select([F.col(c) if c in results.columns else F.lit(None).cast(files.RESULT[c].dataType).alias(c) for c in COLUMNS]).persist()
        try:
            good = F.coalesce(F.col("status") == "success", F.lit(False))
            counts = named.agg(F.count("*").alias("record_count"), F.count_if(good).alias("success_count"), F.count_if(~good).alias("failure_count")).first().asDict()
            bucket = F.pmod(F.xxhash64("image_id"), F.lit(self.buckets)).cast("int")
            latest = first_by(named, ["image_id"], [F.col("rendered_at").desc_nulls_last(), ~good, F.col("source_path"), F.col("status"), *[F.col(c) for c in COLUMNS if c not in ("image_id", "rendered_at", "source_path", "status")]])
            touched = {str(r[0]) for r in named.select(bucket).distinct().collect()}  # at most one row a bucket
            version = f"v-{batch:010d}-{uuid.uuid4().hex}"
            if touched:
                old = self._rows({b: v for b, v in state["buckets"].items() if b in touched})
                seen = Observation()
                fresh = upsert(old, latest, ["image_id"]).withColumn("bucket", bucket).observe(seen, F.count(F.lit(1)).alias("n"))
                fresh.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
                if self._rows(dict.fromkeys(touched, version)).count() != seen.get["n"]:
                    raise ValueError(f"not all rows of batch {batch} can be read back")
            self._switch(json.dumps({"batches": state["batches"] | {writer: batch}, "buckets": state["buckets"] | dict.fromkeys(touched, version)}))
            return counts
        finally:
            named.unpersist()

    def _switch(self, stated: str) -> None:
        files.set_current_version(self.spark, self.path, stated)


def retried(step: Callable[[], dict], attempts: int = 3, delay: float = 1.0) -> dict:
    """The result of a step that is tried again after 1, 2, 4 ... delays; the last failure is passed on."""
    for attempt in range(attempts):
        try:
            return step()
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(delay * 2**attempt)
    raise ValueError("there must be an attempt")


def registry_stream(registry: Registry, source: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Applies the result lines of files that have come to a folder since the last run, a bounded number of files a batch, and ends.

    The checkpoint remembers the files; a batch that was applied but not yet remembered comes again under its number and changes nothing.
    Truncated lines go. A batch that fails three times ends the query with its error and is taken up by the next run."""
    lines = registry.spark.readStream.schema(files.RESULT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(source)
    step = lambda df, number: retried(lambda: registry.apply(df, number, checkpoint))
    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
