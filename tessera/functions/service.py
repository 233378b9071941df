"""Column rules of the slide service: what a request asks for, how it is answered, and under which keys. All are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import nonblank

#: The longest side of a thumbnail, and the reasons whose placeholders expire early.
MOST_SIDE = 2048
PASSING = ["missing", "decode_timeout", "unavailable"]


def query_kind(text: Column) -> Column:
    """sample, patient or slide by the form of a search text, else null; case is ignored."""
    own = F.trim(text)
    return F.when(own.rlike(r"(?i)^P-\d.*-T"), "sample").when(own.rlike("(?i)^P-"), "patient").when(own.rlike(r"^\d"), "slide")


def flag(value: Column, default: bool | None = None) -> Column:
    """true, 1, false and 0 as booleans; a null is the default, any other text an error."""
    own = F.lower(F.trim(value))
    known = F.when(value.isNull(), F.lit(default).cast("boolean")).when(own.isin("true", "1"), True).when(own.isin("false", "0"), False)
    return known.otherwise(F.raise_error(F.concat(F.lit("invalid boolean value: "), value)).cast("boolean"))


def optional_int(value: Column) -> Column:
    return F.trim(value).try_cast("bigint")


def plain(df: DataFrame) -> DataFrame:
    """df with decimals as doubles, as JSON responses have them."""
    return df.select(*[F.col(f"`{n}`").cast("double").alias(n) if t.startswith("decimal") else F.col(f"`{n}`") for n, t in df.dtypes])


def side(pixels: Column) -> Column:
    return F.greatest(F.lit(1), F.least(pixels, F.lit(MOST_SIDE)))


def placeholder_ttl(reason: Column, configured: Column, cache_ttl: Column) -> Column:
    """Seconds that a placeholder is kept, at most as long as thumbnails are (0: no limit); null for other reasons."""
    return F.when(reason.isin(PASSING), F.least(F.greatest(F.lit(1), configured), F.nullif(cache_ttl, F.lit(0))))


def thumbnail_reason(uri: Column, width: Column, height: Column, master_width: Column, master_height: Column) -> Column:
    """missing without a master, master where the request covers it, else resized."""
    return F.when(uri.isNull(), "missing").when((width >= master_width) & (height >= master_height), "master").otherwise("resized")


def masters_root(manifest_uri: Column) -> Column:
    """The folder of rendered masters beside a manifest; blank without one."""
    own = F.trim(manifest_uri)
    folder = F.when(own.endswith("manifest.json"), F.regexp_replace(F.concat(F.lit("/"), own), "/[^/]*$", "")).otherwise(F.regexp_replace(F.concat(F.lit("/"), own), "/+$", ""))
    folder = F.substring(folder, 2, 1 << 20)
    return F.when(F.coalesce(own, F.lit("")) == "", "").otherwise(F.concat(F.when(folder == "", ".").otherwise(folder), F.lit("/masters")))


def artifact_uri(root: Column, image_id: Column) -> Column:
    return F.when(root == "", "").otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), image_id, F.lit(".jpg")))


def bucket(uri: Column) -> Column:
    """The bucket of s3://bucket/key, null where the address is malformed."""
    return nonblank(F.regexp_extract(uri, "^s3://([^/]+)/(.+)$", 1))


def object_key(uri: Column) -> Column:
    return nonblank(F.regexp_extract(uri, "^s3://([^/]+)/(.+)$", 2))


def scoped(study: Column, slide: Column) -> Column:
    return F.when(F.coalesce(study, F.lit("")) != "", F.concat(study, F.lit(":"), slide)).otherwise(slide)


def cache_key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def slide_properties(properties: Column) -> Column:
    """struct(mpp_x, mpp_y, vendor, objective_power) from a map of a file's properties: the reader's own names win over the older ones.
    One value that is no number makes all of them defaults."""
    pick = lambda name: F.coalesce(*[nonblank(properties[f"{space}.{name}"]) for space in ("tiffslide", "openslide")])
    x, y, power = pick("mpp-x"), pick("mpp-y"), pick("objective-power")
    number = lambda c, kind: F.trim(c).try_cast(kind)
    bad = F.lit(False)
    for c, kind in ((x, "double"), (y, "double"), (power, "bigint")):
        bad = bad | (c.isNotNull() & number(c, kind).isNull())
    zero = lambda c: F.when(bad, 0.0).otherwise(F.coalesce(number(c, "double"), F.lit(0.0)))
    return F.struct(
        zero(x).alias("mpp_x"), zero(y).alias("mpp_y"), F.when(bad, "").otherwise(F.coalesce(pick("vendor"), F.lit(""))).alias("vendor"),
        F.when(~bad, number(power, "bigint")).alias("objective_power"),
    )


def claim_refusal(now: Column, audience: str, most_seconds: int) -> Column:
    """Why the claims in alg, typ, aud, scope, sub, study_id, wsi_auth_version, exp and iat are refused; null if they are not. Signatures
    are checked where tokens arrive."""
    c = F.col
    unless = lambda condition: ~F.coalesce(condition, F.lit(False))
    return (
        F.when(unless((c("alg") == "HS256") & (c("typ") == "JWT")), "algorithm")
        .when(unless((c("aud") == audience) & (c("scope") == "wsi:read")), "audience")
        .when(unless(c("sub") != ""), "subject")
        .when(unless(F.trim("study_id") != ""), "study")
        .when(unless(c("wsi_auth_version") == 1), "version")
        .when(unless(c("exp") > now), "expired")
        .when(unless(c("iat") <= now + 60), "issued")
        .when((c("exp") <= c("iat")) | (c("exp") - c("iat") > most_seconds), "lifetime")
    )
