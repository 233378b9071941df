"""A normalised release of the association table: checks, then six tables with internal ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators.relational import first_by, missing
from tessera.plans.canonical import Canonical

RELEASE = "release-1"


class Release:
    """study = patient number mod 3; internal ids are the numbers in the ids."""

    def __init__(self, c: Canonical) -> None:
        self.c = c
        number = F.substring("patient_id", 3, 7).cast("long")
        sample = F.substring_index("sample_id", "-T", -1).cast("long")
        reference = F.substring_index("reference_sample_id", "-T", -1).cast("long")
        self.rows = c.associations.select("*", (number % 3 + 1).alias("study"), number.alias("patient"), sample.alias("sample"), reference.alias("reference"))

    def _table(self, keys: list[str], columns: list[str]) -> DataFrame:
        """The first row, by image and patient, of each key."""
        own = first_by(self.rows, keys, [F.col("image_id"), F.col("patient_id")])
        return own.select(F.col("study").alias("cancer_study_id"), F.lit(RELEASE).alias("release_id"), *columns)

    def parts(self) -> DataFrame:
        return self._table(["study", "patient", "part_key"], [F.col("patient").alias("patient_internal_id"), "part_key", "part_number", "part_type", "part_description", "path_dx_title"])

    def blocks(self) -> DataFrame:
        return self._table(["study", "patient", "part_key", "block_key"], [F.col("patient").alias("patient_internal_id"), "part_key", "block_key", "block_number", "block_label"])

    def slides(self) -> DataFrame:
        return self._table(["study", "image_id"], ["image_id", "stain_name", "stain_group", "is_hne", "is_ihc", "magnification", "file_size_bytes", "can_serve_tiles"])

    def placements(self) -> DataFrame:
        return self.rows.select(F.col("study").alias("cancer_study_id"), F.lit(RELEASE).alias("release_id"), "image_id", F.col("patient").alias("patient_internal_id"), F.col("sample").alias("sample_internal_id"), "part_key", "block_key", "match_level", "specimen_key", "procedure_date_days", "timepoint_source")  # one row for each (patient, image) already

    def patients(self) -> DataFrame:
        return self.rows.groupBy(F.col("study").alias("cancer_study_id"), F.col("patient").alias("patient_internal_id")).agg(F.max("reference").alias("reference_sample_internal_id")).withColumn("release_id", F.lit(RELEASE))

    def violations(self) -> DataFrame:
        """rule and n for every rule; nothing may be written while a count is above 0, except for rules that a caller waives."""
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        unmatched = F.upper("match_level") == "UNMATCHED"
        by_row = {
            "no_image": blank(F.col("image_id")), "bad_part_key": blank(F.col("part_key")) | F.col("part_key").contains("?"), "bad_block_key": blank(F.col("block_key")) | F.col("block_key").contains("?"),
            "bad_level": ~F.upper("match_level").isin("BLOCK", "PART", "UNMATCHED"), "no_specimen": blank(F.col("specimen_key")), "servable_without_path": F.col("can_serve_tiles") & ~X.servable(F.col("slide_path")),
            "unmatched_with_sample": unmatched & F.col("sample_id").isNotNull(), "matched_without_sample": ~unmatched & F.col("sample_id").isNull(),
        }
        # Five aggregates read the rows; they are kept, as the plan beneath them is deep, but as numbers and flags: the texts end here.
        a = self.c.stage(self.rows.select("study", "patient", "sample", "reference", "image_id", *[X.either(c).alias(k) for k, c in by_row.items()]))
        counts = a.agg(*[F.count_if(k).alias(k) for k in by_row])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in by_row])).alias("r")).select("r.*")
        differ = lambda c: F.min(c) != F.max(c)  # noqa: E731  one shuffle, where a distinct count has two
        several = a.groupBy("study", "patient").agg(differ("reference").alias("k")).agg(F.count_if("k").alias("n"))
        twice = a.groupBy("study", "image_id").agg(differ("patient").alias("k")).agg(F.count_if("k").alias("n"))
        customers = self.c.roles.table("customer").select(F.col("c_custkey").alias("patient"))
        orders = self.c.roles.table("orders").select(F.col("o_orderkey").alias("sample"))
        groups = {
            "several_references": several, "image_of_several_patients": twice, "unknown_patient": missing(a, customers, ["patient"]).agg(F.count("*").alias("n")),
            "unknown_sample": missing(a.where(F.col("sample").isNotNull()), orders, ["sample"]).agg(F.count("*").alias("n")),
        }
        return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("rule"), "n") for k, d in groups.items()], rows)
