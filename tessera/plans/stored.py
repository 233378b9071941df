"""Queries whose rows pass through the files, tables and statements around the association table: what is written is read back by its own reader."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import service as S
from tessera.plans import nightly, serving, snapshot_load
from tessera.plans.canonical import Canonical
from tessera.plans.timeline import timeline
from tessera.sources import catalog, documents, files, prefix_index, statements
from tessera.sources.roles import Roles
from tessera.streaming.registry import Registry, registry_stream


#: The time that the registered queries take for their run, so that they give the same rows each time.
CLOCK = datetime(2025, 1, 1, tzinfo=timezone.utc)


def published_summary(spark: SparkSession, folder: str) -> DataFrame:
    return nightly.refresh(spark, folder, files.fresh_path(spark, "nightly"), CLOCK)[1]


def _after_refresh(spark: SparkSession, folder: str) -> Canonical:
    out = files.fresh_path(spark, "nightly")
    nightly.refresh(spark, folder, out, CLOCK)
    return nightly.published(spark, folder, out, CLOCK)


def published_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """The timeline of the table that a night's refresh has published."""
    return timeline(_after_refresh(spark, folder).associations)


def published_resources(spark: SparkSession, folder: str) -> DataFrame:
    """The resource index of the published table."""
    return serving.resources(_after_refresh(spark, folder))


def candidate_file(c: Canonical) -> DataFrame:
    path = files.fresh_path(c.roles.spark, "candidates")
    files.write_candidates(serving.thumbnail_candidates(c), path)
    return files.read_candidates(c.roles.spark, path)


def index_file(c: Canonical) -> DataFrame:
    """The resource index as a document that many tasks write and read."""
    path = files.fresh_path(c.roles.spark, "index")
    documents.publish_index_document(c.stage(serving.resources(c)), path)
    return documents.read_index_document(c.roles.spark, documents.current_document(c.roles.spark, path))


def _prefix_index(c: Canonical) -> str:
    path = files.fresh_path(c.roles.spark, "prefixes")
    prefix_index.write_prefix_index(c.stage(serving.resources(c).select(*prefix_index.SCOPE, "resource_id")), path)
    return path


def stored_suggestions(c: Canonical) -> DataFrame:
    """What the stored index suggests for one text."""
    return prefix_index.prefix_suggestions(c.roles.spark, _prefix_index(c), "study_1", "patient", "p-000")


def requested_suggestions(c: Canonical) -> DataFrame:
    """What it suggests for the beginnings of all customers' ids, in small letters, in each study."""
    text = F.concat(F.lit("p-"), F.left(F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit(5)))
    studies = F.explode(F.array(*[F.lit(f"study_{k}") for k in range(3)]))
    asked = c.roles.table("customer").select(studies.alias("study_id"), F.lit("patient").alias("resource_type"), text.alias("text"))
    return prefix_index.prefix_requests(c.roles.spark, _prefix_index(c), asked)


def _study():
    return F.concat(F.lit("study_"), F.substring("patient_id", 3, 7).cast("int") % 3)


def snapshot_file(c: Canonical, study: str | None = None) -> DataFrame:
    """The slides of a snapshot file, of all studies or of one."""
    path = files.fresh_path(c.roles.spark, "snapshot")
    files.write_snapshot(c.associations, _study(), path)
    lines = files.read_snapshot(c.roles.spark, path, snapshot_load.snapshot_of(c).schema, study)
    return lines.select("study_id", "patient_id", F.explode("slides").alias("s")).select(
        "study_id", "patient_id", *[f"s.{x}" for x in ("image_id", "sample_id", "part_key", "block_key", "can_serve_tiles", "procedure_date_days", "file_size_bytes")])


def stored_release(c: Canonical) -> DataFrame:
    """The parts of the latest of two releases."""
    path, parts = files.fresh_path(c.roles.spark, "release"), snapshot_load.loaded(c, "part")
    files.publish_release({"part": parts.where("false")}, path, "1")
    files.publish_release({"part": parts}, path, "2")
    return files.read_release(c.roles.spark, path, "part").drop("release_id")


def catalog_release(c: Canonical) -> DataFrame:
    """The parts of a release in a catalog table that holds two, after the second was loaded again with other rows."""
    spark, parts = c.roles.spark, files.staged(snapshot_load.loaded(c, "part"))
    name = f"parts_{uuid.uuid4().hex}"
    catalog.create_release_table(spark, name, parts.drop("release_id").schema, files.fresh_path(spark, "catalog"))
    catalog.load_release(parts.drop("release_id"), name, "1")
    for again in (parts.where("false"), parts):
        catalog.load_release(again.drop("release_id"), name, "2")
    return catalog.release_rows(spark, name).drop("release_id")


def study_folders(c: Canonical) -> DataFrame:
    """The samples with slides of each study, under the id that the folder's meta file states, else the folder's name."""
    spark, root = c.roles.spark, files.fresh_path(c.roles.spark, "studies")
    counts = c.associations.where(F.col("sample_id").isNotNull()).groupBy(_study().alias("folder")).agg(F.count_distinct("sample_id").alias("n_samples"), F.count("*").alias("n_slides"))
    for k in (0, 1):
        files.write_meta(spark, f"{root}/study_{k}/meta_study.txt", {"type_of_cancer": "mixed", "cancer_study_identifier": f" stated_{k}"})
    names = [(f"study_{k}", files.study_identifier(spark, f"{root}/study_{k}")) for k in range(3)]
    return counts.join(spark.createDataFrame(names, "folder string, study_id string"), "folder").select("study_id", "n_samples", "n_slides")


def result_lines(c: Canonical) -> DataFrame:
    """Result lines of renderers: every seventh image's line is truncated, every eleventh has no image."""
    n, path = F.col("image_id").cast("long"), files.fresh_path(c.roles.spark, "results")
    line = F.to_json(F.struct(F.when(n % 11 != 0, F.col("image_id")).alias("image_id"), "source_path", "status", "rendered_at"))
    c.roles.registry.select(F.when(n % 7 == 0, F.left(line, F.length(line) - 4)).otherwise(line).alias("value")).write.text(path)
    return files.read_results(c.roles.spark, path).select("image_id", "source_path", "status")


def streamed_registry(c: Canonical) -> DataFrame:
    """The stored registry after result lines of renderers have come to it as a stream, two files a batch."""
    path = files.fresh_path(c.roles.spark, "registry")
    registry = Registry(c.roles.spark, f"{path}/table")
    registry.apply(serving.best_registry(c.roles.registry), 0)
    serving.rendered(c).repartition(4).write.json(f"{path}/results")
    query = registry_stream(registry, f"{path}/results", f"{path}/checkpoint", 2)
    query.awaitTermination()
    return registry.rows().select("image_id", "source_path", "status", "rendered_at")


def manifest_file(c: Canonical) -> DataFrame:
    """A thumbnail manifest with gaps: sizes, types and addresses that are missing, and sizes below one."""
    n, path = F.col("image_id").cast("long"), files.fresh_path(c.roles.spark, "manifest")
    entries = serving.thumbnail_manifest(c).select(
        "image_id", F.when(n % 5 != 0, F.col("uri")).alias("uri"), F.when(n % 3 != 0, n % 2 * 700).alias("width"), F.lit(300).alias("height"),
        F.when(n % 4 == 0, "image/png").alias("content_type"), "source_uri")
    documents.publish_manifest(entries, path, "1", 256, CLOCK.isoformat())
    return documents.read_manifest_document(c.roles.spark, documents.current_document(c.roles.spark, path))


def _clinical(roles: Roles) -> str:
    """A clinical file of the customers: blank ids, ids twice, four header rows and a row of names."""
    path, key = files.fresh_path(roles.spark, "clinical"), F.col("c_custkey")
    own = roles.table("customer").select(F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("P-"), F.lpad(key.cast("string"), 7, "0"))).alias("id"), "c_name", "c_mktsegment", "c_custkey")
    body = own.unionByName(own.where(key % 13 == 0)).select(F.concat_ws("\t", "id", "c_name", "c_mktsegment").alias("value"))
    head = roles.spark.createDataFrame([("#a\tb\tc",)] * 4 + [("PATIENT_ID\tNAME\tSEGMENT",)], "value string")
    head.coalesce(1).unionByName(body.coalesce(1)).coalesce(1).write.text(path)
    return path


def clinical_patients(roles: Roles) -> DataFrame:
    return files.clinical_ids(roles.spark, _clinical(roles))


def positional_patients(roles: Roles) -> DataFrame:
    return files.positional_ids(roles.spark, _clinical(roles))


def pruned_clinical(roles: Roles) -> DataFrame:
    out = files.fresh_path(roles.spark, "pruned")
    files.without_attributes(roles.spark, _clinical(roles), out, ["SEGMENT", "ABSENT"])
    return files.clinical_rows(roles.spark, out)


def resource_file(c: Canonical) -> DataFrame:
    """The patients of a clinical file that have a servable slide, with their viewer address, written in the order of that file."""
    out, ids = files.fresh_path(c.roles.spark, "resources"), files.ordered_ids(c.roles.spark, _clinical(c.roles))
    known = ids.join(serving.servable(c).select(F.col("patient_id").alias("id")), "id", "left_semi")
    address = F.concat(F.lit("/patient/wsiHESlides?studyId=study&caseId="), "id")
    files.write_tsv(known.select(F.col("id").alias("PATIENT_ID"), F.lit("WSI_VIEWER").alias("RESOURCE_ID"), address.alias("URL"), "at"), out, [F.col("at")], ("at",))
    return files.clinical_rows(c.roles.spark, out)


def statement_rows(c: Canonical) -> DataFrame:
    c.roles.cleaned.createOrReplaceTempView("cleaned_slides")
    text = "SELECT image_id, stain_name, magnification FROM cleaned_slides WHERE magnification = :power AND array_contains(:groups, stain_group)"
    return statements.query(c.roles.spark, text, power="40x", groups=["IHC", "H&E (Other)"])


def coerced_values(roles: Roles) -> DataFrame:
    """Texts as flags and numbers, and decimals as doubles."""
    line, key = F.col("l_linenumber"), F.col("l_partkey")
    flag = F.when(line == 1, " TRUE").when(line == 2, "0").when(line == 3, "1 ").when(line == 4, "False")
    number = F.when(key % 3 == 0, F.concat(F.lit(" "), key.cast("string"))).when(key % 3 == 1, "").otherwise("x7")
    own = roles.table("lineitem").select("l_orderkey", "l_linenumber", S.flag(flag, False).alias("flag"), S.optional_int(number).alias("number"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"))
    return S.plain(own)
