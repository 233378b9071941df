"""What a slide service asks: prefix search, the resource index, thumbnail work lists, and study files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators.relational import appended_counts, contiguous_shards, first_by, upsert
from tessera.plans.canonical import Canonical

TOP = 8
INDEX = ["study_id", "resource_type", "resource_id", "patient_id", "source_path"]


def query_kind(text: str) -> str | None:
    """Which ids a search text is a prefix of, by its form; case is ignored."""
    import re

    text = text.strip()
    if re.match(r"P-\d.*-T", text, re.I):
        return "sample"
    return "patient" if re.match("P-", text, re.I) else "slide" if re.match(r"\d", text) else None


def search_patients(c: Canonical, prefix: str) -> DataFrame:
    own = c.roles.block_matched.where(F.col("patient_id").startswith(prefix))
    return own.groupBy("patient_id").agg(F.max("cancer_type").alias("cancer_type"), F.count("*").alias("slide_count")).orderBy("patient_id").limit(TOP)


def search_samples(c: Canonical, prefix: str) -> DataFrame:
    own = c.roles.block_matched.where(F.col("sample_id").startswith(prefix))
    return own.groupBy("sample_id", "patient_id").agg(F.max("cancer_type").alias("cancer_type")).orderBy("sample_id", "patient_id").limit(TOP)


def search_slides(c: Canonical, prefix: str) -> DataFrame:
    """The first slides, each as often as the source has it."""
    own = c.roles.block_matched.where(F.col("image_id").startswith(prefix)).select("image_id", "patient_id", "stain_name")
    return own.orderBy("image_id", "patient_id", "stain_name").limit(TOP)


def suggestions(found: DataFrame, kind: str) -> DataFrame:
    """type, id, label and sublabel of search results; a sublabel has no separator at its ends."""
    identity = F.col("image_id" if kind == "slide" else f"{kind}_id")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    dot = F.lit(" · ")
    sublabel = {
        "patient": lambda: F.btrim(F.concat(part("cancer_type"), dot, part("slide_count"), F.lit(" slides")), F.lit(" ·")),
        "sample": lambda: part("cancer_type"),
        "slide": lambda: F.btrim(F.concat(part("patient_id"), dot, part("stain_name")), F.lit(" ·")),
    }[kind]()
    return found.select(F.lit(kind).alias("type"), identity.alias("id"), identity.alias("label"), sublabel.alias("sublabel"))


def _study(patient):
    return F.concat(F.lit("study_"), F.substring(patient, 3, 7).cast("int") % 3)


def resources(c: Canonical) -> DataFrame:
    """The resource index in long form: the patients, samples and slides of each study."""
    none = F.lit(None).cast("string")
    entry = lambda kind, key, patient=none, path=none: F.struct(F.lit(kind).alias("resource_type"), F.col(key).alias("resource_id"), patient.alias("patient_id"), path.alias("source_path"))
    each = F.explode(F.array(entry("patient", "patient_id"), entry("sample", "sample_id"), entry("slide", "image_id", F.col("patient_id"), F.col("slide_path")))).alias("e")
    return c.associations.select(_study(F.col("patient_id")).alias("study_id"), each).select("study_id", "e.*").where(F.col("resource_id").isNotNull()).distinct()


def slides(c: Canonical) -> DataFrame:
    """The slides of the index alone: the associations are one for each (patient, image), and an index has each row once already."""
    return c.associations.where(F.col("image_id").isNotNull()).select(_study(F.col("patient_id")).alias("study_id"), F.lit("slide").alias("resource_type"), F.col("image_id").alias("resource_id"), "patient_id", F.col("slide_path").alias("source_path"))


def index_suggestions(index: DataFrame, study: str, kind: str, text: str) -> DataFrame:
    """The first ids of a study with a prefix, ignoring case; filters on stored columns reach the scan."""
    own = index.where((F.col("study_id") == study) & (F.col("resource_type") == kind) & F.lower("resource_id").startswith(text.lower()))
    return own.select("resource_id").distinct().orderBy(F.lower("resource_id"), "resource_id").limit(TOP)


def index_membership(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (study_id, resource_type, resource_id) that the index holds."""
    keys = ["study_id", "resource_type", "resource_id"]
    return wanted.select(keys).distinct().join(index.select(keys), keys, "left_semi")


def index_merge(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Studies of the fresh index replace those of the same id; others stay."""
    return existing.join(fresh.select("study_id").distinct(), "study_id", "left_anti").select(INDEX).unionByName(fresh.select(INDEX))


def best_registry(registry: DataFrame) -> DataFrame:
    """The registry row of each image: a success, then the latest, then the least path and status."""
    return first_by(registry, ["image_id"], [F.col("status") != "success", F.col("rendered_at").desc(), F.col("source_path"), F.col("status")])


def servable_paths(c: Canonical) -> DataFrame:
    own = c.roles.inventory.where(X.servable(F.col("path")) & F.col("image_id").isNotNull())
    return first_by(own, ["image_id"], [X.path_rank(F.col("path")), F.col("path")])


def thumbnail_candidates(c: Canonical, failures: bool = False) -> DataFrame:
    """Images to render: new ones and successes whose path changed; or, with failures, those whose last result is no success."""
    known = best_registry(c.roles.registry).select("image_id", "source_path", "status")
    if failures:
        return servable_paths(c).join(known.where(F.col("status") != "success").select("image_id"), "image_id", "left_semi")
    both = servable_paths(c).join(known, "image_id", "left")
    new, moved = F.col("status").isNull(), (F.col("status") == "success") & (F.col("source_path") != F.col("path"))
    return both.where(new | moved).select("image_id", "path")


def thumbnail_shards(c: Canonical, per_shard: int = 2000, most: int = 480) -> DataFrame:
    return contiguous_shards(thumbnail_candidates(c), [F.col("image_id")], per_shard, most)


def rendered(c: Canonical) -> DataFrame:
    """Results of rendering the candidates; every ninth fails."""
    n = F.col("image_id").cast("long")
    return thumbnail_candidates(c).select("image_id", F.col("path").alias("source_path"), F.when(n % 9 == 0, "failed").otherwise("success").alias("status"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("rendered_at"))


def registry_upsert(c: Canonical) -> DataFrame:
    return upsert(best_registry(c.roles.registry), rendered(c), ["image_id"])


def thumbnail_manifest(c: Canonical) -> DataFrame:
    """Successful results whose path is still the inventory's."""
    good = best_registry(c.roles.registry).where(F.col("status") == "success").select("image_id", F.col("source_path").alias("path"))
    return servable_paths(c).join(good, ["image_id", "path"]).select("image_id", F.col("path").alias("source_uri"), F.concat(F.lit("thumbnails/"), "image_id", F.lit(".jpg")).alias("uri"))


def servable(c: Canonical) -> DataFrame:
    """The associations whose slide can be served."""
    return c.associations.where(X.servable(F.col("slide_path")))


def resource_patients(c: Canonical, own: DataFrame | None = None) -> DataFrame:
    """The patients of a clinical file (the customers) that have a servable slide, with their viewer address."""
    listed = c.roles.table("customer").select(F.concat(F.lit("P-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("patient_id"))
    known = listed.join((servable(c) if own is None else own).select("patient_id"), "patient_id", "left_semi").distinct()
    return known.select("patient_id", F.lit("WSI_VIEWER").alias("resource_id"), F.concat(F.lit("/patient/wsiHESlides?studyId=study&caseId="), "patient_id").alias("url"))


def manifest_stats(c: Canonical) -> DataFrame:
    """When and how the servable associations of the listed patients were made, and how many there are; the time of the run if there are none."""
    rows = c.stage(servable(c).select("patient_id", "updated_at", "association_version"))
    own = rows.join(resource_patients(c, rows).select("patient_id"), "patient_id", "left_semi")
    return own.agg(
        F.coalesce(F.max("updated_at"), F.lit(c.at).cast("timestamp")).alias("updated_at"), F.max("association_version").alias("association_version"),
        F.count("*").alias("n_rows"), F.count_distinct("patient_id").alias("n_patients"))


def counted_samples(c: Canonical) -> DataFrame:
    """The rows of a clinical sample file with slide counts appended; 0 where a sample has no slide."""
    rows = c.roles._orders.select("sample_id", F.col("o_orderstatus").alias("status"))
    return appended_counts(rows, c.match_counts, "sample_id", ["n_slides", "n_part", "n_block"])
