"""Tile and thumbnail planning over tables of slides: which level to read, how much of it, and what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.roles import Roles

TILE, MOST_PIXELS, THUMBNAIL = 256, 150_000, 512


def slides(roles: Roles) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return roles.table("part").select(key.alias("slide_id"), (size * 1500 + key % 700 + 100).cast("long").alias("width"), (key * 37 % 40000 + 90).cast("long").alias("height"), (size % 6 + 1).cast("int").alias("levels"))


def tile_requests(roles: Roles) -> DataFrame:
    own = roles.table("lineitem").select(F.col("l_partkey").alias("slide_id"), F.col("l_linenumber").cast("int").alias("z"), (F.col("l_suppkey") % 7).cast("int").alias("x"), (F.col("l_partkey") % 5).cast("int").alias("y")).distinct()
    return own.join(slides(roles), "slide_id")


def max_zoom() -> Column:
    return F.ceil(F.log2(F.greatest("width", "height") / F.lit(float(TILE)))).cast("int")


def tile_geometry(requests: DataFrame) -> DataFrame:
    """Adds max_zoom, downsample, the clipped source rectangle, the output size and status: ok, out_of_range or out_of_bounds."""
    top = requests.withColumn("max_zoom", max_zoom())
    inside = F.col("z").between(0, F.col("max_zoom"))
    scaled = top.withColumn("downsample", F.when(inside, F.pow(F.lit(2), F.col("max_zoom") - F.col("z")).cast("long")))
    at = scaled.withColumn("x0", F.col("x") * TILE * F.col("downsample")).withColumn("y0", F.col("y") * TILE * F.col("downsample"))
    beyond = (F.col("x0") >= F.col("width")) | (F.col("y0") >= F.col("height"))
    at = at.withColumn("status", F.when(~inside, "out_of_range").when(beyond, "out_of_bounds").otherwise("ok"))
    ok = F.col("status") == "ok"
    at = at.withColumn("source_width", F.when(ok, F.least(TILE * F.col("downsample"), F.col("width") - F.col("x0")))).withColumn("source_height", F.when(ok, F.least(TILE * F.col("downsample"), F.col("height") - F.col("y0"))))
    out = lambda c: F.ceil(F.col(c) / F.col("downsample")).cast("long")
    return at.withColumn("out_width", out("source_width")).withColumn("out_height", out("source_height"))


def decode_plan(requests: DataFrame, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """Adds the best level (the highest whose downsample is at most the tile's), what to read of it, and status blank or too_large."""
    g = tile_geometry(requests)
    level = F.when(F.col("status") == "ok", F.least(F.col("levels") - 1, F.col("max_zoom") - F.col("z")))
    g = g.withColumn("level", level).withColumn("level_downsample", F.pow(F.lit(2), "level").cast("long"))
    whole = lambda a: F.floor(F.col(a) / F.col("level_downsample"))
    read = lambda s, a, o: F.least(F.ceil(F.col(s) / F.col("level_downsample")), whole(a) - whole(o)).cast("long")
    g = g.withColumn("read_width", read("source_width", "width", "x0")).withColumn("read_height", read("source_height", "height", "y0"))
    blank = (F.col("read_width") <= 0) | (F.col("read_height") <= 0)
    g = g.withColumn("pixels", F.when(blank, F.lit(0)).otherwise(F.col("read_width") * F.col("read_height")).cast("long"))
    return g.withColumn("status", F.when(F.col("status") != "ok", F.col("status")).when(blank, "blank").when(F.col("pixels") > most_pixels, "too_large").otherwise("ok"))


def own_levels(requests: DataFrame) -> DataFrame:
    """Adds level_downsamples, level_widths and level_heights as files state them: pyramids by 2, 3 or 4, of which some are slightly off."""
    base, off = F.col("slide_id") % 3 + 2, F.when(F.col("slide_id") % 5 == 0, 0.25).otherwise(0.0)
    scales = F.transform(F.sequence(F.lit(0), F.col("levels") - 1), lambda i: F.when(i == 0, 1.0).otherwise(F.pow(base, i) + off))
    sides = lambda c: F.transform("level_downsamples", lambda d: F.floor(F.col(c) / d).cast("long"))
    return requests.withColumn("level_downsamples", scales).withColumn("level_widths", sides("width")).withColumn("level_heights", sides("height"))


def best_level(downsamples: Column, target: Column) -> Column:
    """The last level whose downsample is at most the target, else level 0."""
    at = F.filter(F.sequence(F.lit(0), F.size(downsamples) - 1), lambda i: F.get(downsamples, i) <= target)
    return F.coalesce(F.array_max(at), F.lit(0))


def decode_plan_by_levels(requests: DataFrame, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """decode_plan for slides whose files state each level's downsample and size (columns of own_levels), whatever the steps between them."""
    g = tile_geometry(requests)
    ok = F.col("status") == "ok"
    g = g.withColumn("level", F.when(ok, best_level(F.col("level_downsamples"), F.col("downsample"))))
    g = g.withColumn("level_downsample", F.get("level_downsamples", F.col("level")))
    read = lambda s, o, a: F.least(F.ceil(F.col(s) / F.col("level_downsample")), F.get(a, F.col("level")) - F.floor(F.col(o) / F.col("level_downsample"))).cast("long")
    g = g.withColumn("read_width", F.when(ok, read("source_width", "x0", "level_widths"))).withColumn("read_height", F.when(ok, read("source_height", "y0", "level_heights")))
    blank = (F.col("read_width") <= 0) | (F.col("read_height") <= 0)
    g = g.withColumn("pixels", F.when(blank, F.lit(0)).otherwise(F.col("read_width") * F.col("read_height")).cast("long"))
    g = g.withColumn("status", F.when(~ok, F.col("status")).when(blank, "blank").when(F.col("pixels") > most_pixels, "too_large").otherwise("ok"))
    return g.drop("level_downsamples", "level_widths", "level_heights")


def thumbnail_plan(own: DataFrame, size: int = THUMBNAIL, most_pixels: int = 4_000_000) -> DataFrame:
    """The smallest level with few enough pixels that covers the target, else the largest such level; status no_safe_level if none."""
    scale = F.least(F.lit(size) / F.col("width"), F.lit(size) / F.col("height"), F.lit(1.0))
    target = lambda c: F.greatest(F.lit(1), F.least(F.col(c), F.bround(F.col(c) * scale).cast("long"))).cast("long")
    t = own.withColumn("target_width", target("width")).withColumn("target_height", target("height"))
    side = lambda c, i: F.floor(F.col(c) / F.pow(F.lit(2), i)).cast("long")
    safe = F.filter(F.sequence(F.lit(0), F.col("levels") - 1), lambda i: side("width", i) * side("height", i) <= most_pixels)
    t = t.withColumn("_safe", safe)
    large = F.filter("_safe", lambda i: (side("width", i) >= F.col("target_width")) & (side("height", i) >= F.col("target_height")))
    t = t.withColumn("level", F.coalesce(F.array_max(large), F.array_min("_safe")))
    return t.withColumn("status", F.when(F.col("level").isNull(), "no_safe_level").otherwise("ok")).withColumn("read_width", side("width", F.col("level"))).withColumn("read_height", side("height", F.col("level"))).drop("_safe")
