"""All queries of the library outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.plans import geometry, operations, requests, serving, snapshot_load, stored
from tessera.plans.canonical import Canonical
from tessera.plans.release import Release
from tessera.plans.sql import ORACLES
from tessera.plans.timeline import timeline
from tessera.sources.roles import Roles
from tessera.streaming.limiter import rate_limit_admissions

__all__ = ["ORACLES", "QUERIES"]


_held: list[Canonical] = []


def _canonical(make: Callable[[Canonical], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the canonical steps. Those that the query before has staged are freed: an earlier result that is still used derives
    them again, and a session holds the steps of one query at most."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        while _held:
            _held.pop().release()
        _held.append(Canonical(Roles(spark, folder), at=stored.CLOCK))
        return make(_held[0])

    return run


def _roles(make: Callable[[Roles], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: make(Roles(spark, folder))


def _wanted(c: Canonical) -> DataFrame:
    return c.roles._orders.select("sample_id")


def _stains(c: Canonical) -> DataFrame:
    g, n = F.col("stain_group"), F.col("stain_name")
    return c.roles.cleaned.select(g, n).distinct().select(
        g, n, X.hne_by_name_or_group(g, n).alias("canonical_hne"), X.ihc_by_group(g).alias("canonical_ihc"), X.hne_collapsed(g, n).alias("collapsed_hne"), X.exclusive_subtype(g, n).alias("subtype"),
        X.hne_by_substring(g, n).alias("substring_hne"), X.ihc_by_substring(g).alias("substring_ihc"), X.hne_diagnostic(g).alias("diagnostic_hne"), X.ihc_diagnostic(g, n).alias("diagnostic_ihc"),
    )


def _membership(c: Canonical) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    wanted = c.roles.table("customer").select(F.concat(F.lit("study_"), (F.col("c_custkey") % 3).cast("string")).alias("study_id"), F.lit("patient").alias("resource_type"), F.concat(F.lit("P-"), F.lpad(key, 7, "0")).alias("resource_id"))
    return serving.index_membership(serving.resources(c), wanted)


def _merge(c: Canonical) -> DataFrame:
    index = c.stage(serving.resources(c))
    return serving.index_merge(index, index.where((F.col("study_id") == "study_1") & (F.col("resource_type") == "slide")))


def _derivation(c: Canonical) -> DataFrame:
    own = c.roles.cleaned.select("block_id", "block_label").distinct()
    return own.select("block_id", "block_label", X.block_fields(F.col("block_id"), F.col("block_label")).alias("f")).select("block_id", "block_label", "f.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "best_path_per_image": _canonical(lambda c: c.paths),
    "sample_sequencing_date": _canonical(lambda c: c.sequencing),
    "patient_sample_pairs": _canonical(lambda c: c.pairs),
    "patient_reference_sample": _canonical(lambda c: c.references),
    "procedure_dates": _canonical(lambda c: c.procedures),
    "slide_procedure_dates": _canonical(lambda c: c.slide_dates),
    "block_matches": _canonical(lambda c: c.block_matches),
    "part_matches": _canonical(lambda c: c.part_matches),
    "unmatched_associations": _canonical(lambda c: c.unmatched),
    "canonical_associations": _canonical(lambda c: c.associations),
    "sample_summary": _canonical(lambda c: c.summary),
    "summary_lookup": _canonical(lambda c: c.summaries_of(_wanted(c))),
    "live_sample_summary": _canonical(lambda c: c.live_summary(_wanted(c))),
    "sample_match_counts": _canonical(lambda c: c.match_counts),
    "patient_slide_listing": _canonical(lambda c: c.listing("P-0000007")),
    "counted_samples": _canonical(serving.counted_samples),
    "resource_patients": _canonical(serving.resource_patients),
    "resource_manifest_stats": _canonical(serving.manifest_stats),
    "search_patients": _canonical(lambda c: serving.search_patients(c, "P-00000")),
    "search_samples": _canonical(lambda c: serving.search_samples(c, "P-000001")),
    "search_slides": _canonical(lambda c: serving.search_slides(c, "12")),
    "patient_suggestions": _canonical(lambda c: serving.suggestions(serving.search_patients(c, "P-00000"), "patient")),
    "sample_suggestions": _canonical(lambda c: serving.suggestions(serving.search_samples(c, "P-000001"), "sample")),
    "slide_suggestions": _canonical(lambda c: serving.suggestions(serving.search_slides(c, "12"), "slide")),
    "search_routing": _roles(requests.search_routing),
    "slide_metadata": _canonical(requests.slide_metadata),
    "slide_bindings": _canonical(requests.bindings_of_all_studies),
    "preferred_associations": _canonical(requests.preferred_associations),
    "resource_index": _canonical(serving.resources),
    "index_suggestions": _canonical(lambda c: serving.index_suggestions(serving.resources(c), "study_1", "slide", "1")),
    "stored_suggestions": _canonical(stored.stored_suggestions),
    "requested_suggestions": _canonical(stored.requested_suggestions),
    "index_membership": _canonical(_membership),
    "index_merge": _canonical(_merge),
    "registry_best": _canonical(lambda c: serving.best_registry(c.roles.registry)),
    "thumbnail_candidates": _canonical(serving.thumbnail_candidates),
    "thumbnail_retry": _canonical(lambda c: serving.thumbnail_candidates(c, failures=True)),
    "thumbnail_shards": _canonical(serving.thumbnail_shards),
    "candidate_slices": _canonical(requests.candidate_slices),
    "publish_counts": _roles(lambda r: requests.publish_counts(r.registry)),
    "thumbnail_responses": _canonical(requests.thumbnail_responses),
    "slide_addresses": _roles(requests.slide_addresses),
    "slide_properties": _roles(requests.slide_properties),
    "token_decisions": _roles(requests.token_decisions),
    "registry_upsert": _canonical(serving.registry_upsert),
    "thumbnail_manifest": _canonical(serving.thumbnail_manifest),
    "release_part": _canonical(lambda c: Release(c).parts()),
    "release_block": _canonical(lambda c: Release(c).blocks()),
    "release_slide": _canonical(lambda c: Release(c).slides()),
    "release_placement": _canonical(lambda c: Release(c).placements()),
    "release_patient": _canonical(lambda c: Release(c).patients()),
    "release_violations": _canonical(lambda c: Release(c).violations()),
    **{f"loaded_{t}": _canonical(lambda c, t=t: snapshot_load.loaded(c, t)) for t in ("part", "block", "slide", "placement", "patient")},
    "load_violations": _canonical(snapshot_load.load_violations),
    "timeline_events": _canonical(lambda c: timeline(c.associations)),
    "stain_classifier_matrix": _canonical(_stains),
    "block_field_derivation": _canonical(_derivation),
    "tile_geometry": _roles(lambda r: geometry.tile_geometry(geometry.tile_requests(r))),
    "decode_plan": _roles(lambda r: geometry.decode_plan(geometry.tile_requests(r))),
    "decode_plan_by_levels": _roles(lambda r: geometry.decode_plan_by_levels(geometry.own_levels(geometry.tile_requests(r)))),
    "thumbnail_plan": _roles(lambda r: geometry.thumbnail_plan(geometry.slides(r))),
    "latency_percentiles": _roles(lambda r: operations.latency_percentiles(r.table("events"))),
    "metric_histogram": _roles(lambda r: operations.metric_histogram(r.table("events"))),
    "cache_prune_plan": _roles(lambda r: operations.cache_prune_plan(operations.cache_entries(r.table("part")))),
    "published_summary": stored.published_summary,
    "published_timeline": stored.published_timeline,
    "published_resources": stored.published_resources,
    "candidate_file": _canonical(stored.candidate_file),
    "index_file": _canonical(stored.index_file),
    "snapshot_file": _canonical(stored.snapshot_file),
    "snapshot_of_study": _canonical(lambda c: stored.snapshot_file(c, "study_1")),
    "stored_release": _canonical(stored.stored_release),
    "catalog_release": _canonical(stored.catalog_release),
    "study_folders": _canonical(stored.study_folders),
    "result_lines": _canonical(stored.result_lines),
    "streamed_registry": _canonical(stored.streamed_registry),
    "manifest_file": _canonical(stored.manifest_file),
    "clinical_patients": _roles(stored.clinical_patients),
    "positional_patients": _roles(stored.positional_patients),
    "pruned_clinical": _roles(stored.pruned_clinical),
    "resource_file": _canonical(stored.resource_file),
    "statement_rows": _canonical(stored.statement_rows),
    "coerced_values": _roles(stored.coerced_values),
    "rate_limit_admissions": _roles(lambda r: rate_limit_admissions(r.table("events"))),
}
