"""Requests to the slide service as tables: how searches are routed, slides looked up, thumbnails answered and tokens refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import service as S
from tessera.operators.relational import first_by, round_robin_shards
from tessera.plans import serving
from tessera.plans.canonical import COLUMNS, Canonical
from tessera.sources.roles import Roles

NOW, AUDIENCE, MOST_SECONDS = 1_000_000_000, "viewer", 300_000_000
MANIFEST, MASTER = "s3://primary/thumbnails/manifest.json", 512


def search_routing(roles: Roles) -> DataFrame:
    """The kind of ids that each search text is a prefix of."""
    key = F.col("c_custkey").cast("string")
    patient = F.concat(F.lit("P-"), F.lpad(key, 7, "0"))
    texts = F.explode(F.array(patient, F.concat(F.lower(patient), F.lit("-t1")), F.concat(F.lit(" "), key, F.lit(" ")), F.col("c_name"), F.lit("P-"))).alias("text")
    return roles.table("customer").select(texts).distinct().select("text", S.query_kind(F.col("text")).alias("kind"))


def slide_metadata(c: Canonical) -> DataFrame:
    """The stored metadata of each image, from its first patient."""
    own = first_by(c.associations.select("image_id", "patient_id", "stain_name", "stain_group", "magnification", "file_size_bytes"), ["image_id"], [F.col("patient_id")])
    return own.drop("patient_id")


def slide_bindings(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The patient and path that a study's index binds each wanted (study_id, image_id) to; unbound ones are omitted."""
    bound = index.where(F.col("resource_type") == "slide").select("study_id", F.col("resource_id").alias("image_id"), "patient_id", "source_path")
    return bound.join(wanted.select("study_id", "image_id"), ["study_id", "image_id"], "left_semi")


def bindings_of_all_studies(c: Canonical) -> DataFrame:
    """Every image with a path is wanted in each study: one row an image stands for the wanted rows of all studies, and paths are not asked for."""
    bound = serving.slides(c).where(F.col("study_id").isin([f"study_{k}" for k in range(3)]))
    wanted = c.roles.inventory.where(F.col("path").isNotNull()).select("image_id")
    return bound.select("study_id", F.col("resource_id").alias("image_id"), "patient_id", "source_path").join(wanted, "image_id", "left_semi").select("study_id", "image_id", "patient_id", "source_path")


def candidate_slices(c: Canonical, tasks: int = 7) -> DataFrame:
    return round_robin_shards(serving.thumbnail_candidates(c), [F.col("image_id")], tasks)


def publish_counts(results: DataFrame) -> DataFrame:
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    return results.agg(F.count_if(good).alias("success_count"), F.count_if(~good).alias("failure_count"), F.count("*").alias("record_count"))


def thumbnail_requests(roles: Roles) -> DataFrame:
    study = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("study_"), F.col("l_suppkey").cast("string")))
    return roles.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("image_id"), study.alias("study_id"),
        (F.col("l_quantity") * 50 - 60).cast("int").alias("asked_width"), (F.col("l_linenumber") * 400 - 500).cast("int").alias("asked_height"),
    ).distinct()


def thumbnail_responses(c: Canonical, placeholder_ttl: int = 60, cache_ttl: int = 45) -> DataFrame:
    """What each thumbnail request gets: the clipped size, the master, a resized one or a placeholder, its key and for how long."""
    own = thumbnail_requests(c.roles).join(serving.thumbnail_manifest(c).select("image_id", "uri"), "image_id", "left")
    own = own.withColumn("width", S.side(F.col("asked_width"))).withColumn("height", S.side(F.col("asked_height")))
    own = own.withColumn("reason", S.thumbnail_reason(F.col("uri"), F.col("width"), F.col("height"), F.lit(MASTER), F.lit(MASTER)))
    slide = S.scoped(F.col("study_id"), F.col("image_id"))
    return own.select(
        "image_id", "width", "height", F.when(F.col("reason") == "missing", "placeholder").otherwise("ok").alias("status"), "reason",
        S.placeholder_ttl(F.col("reason"), F.lit(placeholder_ttl), F.lit(cache_ttl)).alias("ttl"), S.cache_key("thumbnail", slide, F.col("width"), F.col("height")).alias("cache_key"),
    )


def slide_addresses(roles: Roles) -> DataFrame:
    """Where each file lies and where its master goes; a path outside the store has no bucket."""
    path = F.col("path")
    return roles.inventory.select("image_id", "path", S.bucket(path).alias("bucket"), S.object_key(path).alias("object_key"), S.artifact_uri(S.masters_root(F.lit(MANIFEST)), F.col("image_id")).alias("artifact_uri")).distinct()


def file_properties(roles: Roles) -> DataFrame:
    """Parts in the role of slide files: some name their properties as older readers do, some lack them, some hold no number."""
    size, key = F.col("p_size"), F.col("p_partkey")
    space = F.when(size % 3 == 0, "openslide.").otherwise("tiffslide.")
    entry = lambda name, value: F.struct(F.concat(space, F.lit(name)).alias("k"), value.alias("v"))
    power = F.when(key % 29 == 0, "forty").when(key % 5 != 0, (size % 4 * 10 + 10).cast("string"))
    return roles.table("part").select(key.alias("slide_id"), F.map_from_entries(F.array(
        entry("mpp-x", F.concat(F.lit("0."), (size + 10).cast("string"))), entry("mpp-y", F.when(size % 7 == 0, "").otherwise("0.25")), entry("vendor", F.when(size % 2 == 0, F.col("p_brand"))), entry("objective-power", power),
    )).alias("properties"))


def slide_properties(roles: Roles) -> DataFrame:
    return file_properties(roles).select("slide_id", S.slide_properties(F.col("properties")).alias("p")).select("slide_id", "p.*")


def token_claims(roles: Roles) -> DataFrame:
    """Orders in the role of token claims, with one in several wrong in each way."""
    key, day = F.col("o_orderkey"), F.unix_timestamp(F.col("o_orderdate"))
    return roles.table("orders").select(
        key.alias("token_id"), F.when(key % 41 == 0, "none").otherwise("HS256").alias("alg"), F.lit("JWT").alias("typ"), F.when(F.col("o_orderstatus") == "P", "other").otherwise(AUDIENCE).alias("aud"),
        F.lit("wsi:read").alias("scope"), F.when(key % 37 != 0, F.col("o_custkey").cast("string")).alias("sub"), F.when(key % 31 == 0, " ").otherwise("study_1").alias("study_id"),
        F.when(key % 23 == 0, 2).otherwise(1).alias("wsi_auth_version"), (day + F.col("o_custkey") * 3_000_000 - 1000).alias("exp"), day.alias("iat"),
    )


def token_decisions(roles: Roles) -> DataFrame:
    return token_claims(roles).select("token_id", S.claim_refusal(F.lit(NOW), AUDIENCE, MOST_SECONDS).alias("refusal"))


def preference(block_id: Column, date: Column) -> list[Column]:
    """The order in which association rows of one slide are preferred: path, level, sample, part, block, stain, description, date."""
    text = lambda c: F.coalesce(X.nonblank(c), F.lit("~" * 8))
    lacks = lambda c: F.coalesce(c, F.lit("")) == ""
    own_part = F.when(F.col("part_number").rlike("^[0-9]+$"), F.col("part_number").try_cast("bigint"))
    own_block = F.trim(F.coalesce("block_number", F.lit("")))
    derived = X.block_fields(block_id, F.col("block_label"))
    part = F.coalesce(own_part, derived["part"])
    block = F.when(own_block == "", derived["block"]).otherwise(own_block)
    return [
        X.path_rank(F.col("slide_path")), X.level_rank(F.col("match_level")), lacks(F.col("sample_id")), text(F.col("sample_id")), F.when(part.isNull(), "~" * 8).otherwise(F.format_string("%08d", part)),
        text(block), text(F.col("stain_group")), text(F.col("stain_name")), lacks(F.col("part_description")), text(F.col("part_description")), date.isNull(), F.col("image_id"),
    ]


def preferred_associations(c: Canonical) -> DataFrame:
    """The preferred row of each (patient, image) among all matches; rows with a blank key go. Ties are settled by the other columns."""
    rows = c.candidates.withColumn("_patient", F.trim("patient_id")).withColumn("_image", F.trim("image_id")).where((F.col("_patient") != "") & (F.col("_image") != ""))
    order = preference(F.lit(None).cast("string"), F.col("procedure_date"))
    rest = [F.col(k).asc_nulls_first() for k in ("part_key", "block_key", "part_type", "path_dx_title", "block_label", "magnification", "file_size_bytes", "procedure_date", "slide_path", "part_number", "block_number")]
    return first_by(rows, ["home", "_patient", "_image"], [*order, *rest]).select(COLUMNS)
