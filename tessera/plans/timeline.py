"""Pathology timeline events: slides of one patient, day, specimen and stain become one event with counts and a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X

STUDY = "study"


def timeline(rows: DataFrame) -> DataFrame:
    """rows: canonical associations, one for each (patient, image)."""
    level = F.upper(F.coalesce("match_level", F.lit("UNMATCHED")))
    own = F.trim(F.coalesce("block_number", F.lit("")))
    derived = X.block_fields(F.lit(None).cast("string"), F.col("block_label"))
    known = own != ""
    number = F.when(F.col("part_number").rlike("^[0-9]+$"), F.col("part_number").try_cast("int"))
    usable = rows.where((F.trim("patient_id") != "") & (F.trim("image_id") != "") & F.col("procedure_date_days").isNotNull()).select(
        F.trim("patient_id").alias("patient"), F.trim("image_id").alias("image"), F.col("procedure_date_days").cast("int").alias("day"), X.exclusive_subtype(F.col("stain_group"), F.col("stain_name")).alias("subtype"),
        level.alias("level"), F.when(known, number).otherwise(derived["part"]).alias("part"), F.when(known, own).otherwise(derived["block"]).alias("block"),
        F.when(known, F.col("block_label")).otherwise(derived["label"]).alias("label"), "part_description", "sample_id", "specimen_key", "can_serve_tiles", "timepoint_source",
    ).where(F.col("subtype").isNotNull())
    shown = usable.select(
        "patient", "day", "image", "subtype", "timepoint_source", "can_serve_tiles",
        F.coalesce(X.nonblank(F.col("sample_id")), F.when(F.col("level") == "UNMATCHED", "Unmatched"), F.lit("")).alias("sample"),
        F.when(F.col("level") == "UNMATCHED", "Unmatched").otherwise(F.col("level")).alias("match"),
        X.specimen_label(F.col("level"), F.col("part"), F.col("part_description"), F.col("label"), F.col("block")).alias("specimen"),
        F.coalesce(X.nonblank(F.col("specimen_key")), X.specimen_key(F.col("level"), F.col("part"), F.col("block"))).alias("key"),
    )
    token = F.when(F.col("can_serve_tiles"), F.col("key")).otherwise(F.col("specimen")).alias("token")
    images = lambda c: F.size(F.collect_set(F.when(c, F.col("image")))).cast("long")  # noqa: E731  an event's images are few; three distinct counts would triple the rows
    events = shown.groupBy("patient", "day", "sample", "match", "specimen", token, "subtype").agg(
        images(F.col("can_serve_tiles")).alias("served"), images(~F.col("can_serve_tiles")).alias("unserved"), images(F.lit(True)).alias("total"), F.array_join(F.array_sort(F.collect_set(X.nonblank(F.col("timepoint_source")))), ", ").alias("source"), F.min("key").alias("key"),
    )
    real = (F.col("sample") != "") & (F.col("sample") != "Unmatched")
    link = F.concat(
        F.lit(f"/patient/wsiHESlides?studyId={STUDY}&caseId="), X.form_encoded(F.col("patient")), F.lit("&stainFilter="), F.when(F.col("subtype") == "H&E", "hne").otherwise("ihc"),
        F.lit("&matchLevel="), X.form_encoded(F.col("match")), F.lit("&specimenKey="), X.form_encoded(F.col("key")), F.when(real, F.concat(F.lit("&sampleId="), X.form_encoded(F.col("sample")))).otherwise(""),
    )
    text = lambda c: F.col(c).cast("string")
    return events.select(
        F.col("patient").alias("PATIENT_ID"), text("day").alias("START_DATE"), F.lit("").alias("STOP_DATE"), F.lit("PATHOLOGY SLIDES").alias("EVENT_TYPE"), F.col("sample").alias("SAMPLE_ID"),
        F.col("subtype").alias("SUBTYPE"), F.col("match").alias("MATCH_LEVEL"), F.col("specimen").alias("SPECIMEN"), text("served").alias("IMAGE_COUNT"), text("unserved").alias("NON_SERVABLE_IMAGE_COUNT"),
        text("total").alias("TOTAL_IMAGE_COUNT"), F.col("source").alias("TIMEPOINT_SOURCE"), F.when(F.col("served") < 1, "").otherwise(link).alias("LINKOUT"),
    )
