"""Column rules of the slide domain: stains, keys, paths, dates and display texts. All are plain expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The store whose paths are preferred, and how servable paths begin.
PRIMARY_STORE, SERVABLE = "s3://primary/", "s3://"
#: What the stain rules compare with.
HNE_GROUPS = ["h&e (initial)", "h&e (other)", "h&e"]
HNE_NAMES = ["h&e", "he"]
DIAGNOSTIC_HNE = ["H&E (Initial)", "H&E (Other)"]


def either(condition: Column) -> Column:
    """condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def nonblank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def servable(path: Column) -> Column:
    return either(path.startswith(SERVABLE))


def path_rank(path: Column) -> Column:
    return F.when(path.startswith(PRIMARY_STORE), 0).when(path.startswith(SERVABLE), 1).otherwise(2)


def level_rank(level: Column) -> Column:
    known = F.coalesce(F.upper(level), F.lit("UNMATCHED"))
    return F.when(known == "BLOCK", 0).when(known == "PART", 1).when(known == "UNMATCHED", 2).otherwise(3)


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def hne_by_name_or_group(group: Column, name: Column) -> Column:
    """The canonical table's rule."""
    return either(F.lower(group).isin(HNE_GROUPS)) | either(F.lower(F.trim(name)).isin(HNE_NAMES))


def ihc_by_group(group: Column) -> Column:
    return either(F.lower(group) == "ihc")


def hne_collapsed(group: Column, name: Column) -> Column:
    """As the canonical rule, with white space inside the name made one space."""
    return either(F.lower(group).isin(HNE_GROUPS)) | F.lower(one_space(name)).isin(HNE_NAMES)


def exclusive_subtype(group: Column, name: Column) -> Column:
    """IHC wins, then H&E, else none."""
    return F.when(ihc_by_group(group), "IHC").when(hne_collapsed(group, name), "H&E")


def hne_by_substring(group: Column, name: Column) -> Column:
    return F.lower(F.coalesce(group, name, F.lit(""))).contains("h&e")


def ihc_by_substring(group: Column) -> Column:
    return F.lower(F.coalesce(group, F.lit(""))).contains("ihc")


def hne_diagnostic(group: Column) -> Column:
    return either(group.isin(DIAGNOSTIC_HNE))


def ihc_diagnostic(group: Column, name: Column) -> Column:
    """Stained IHC slides: not recuts, not unstained."""
    text = F.lower(F.coalesce(name, F.lit("")))
    return either(group == "IHC") & ~F.trim(text).startswith("immuno recut") & ~text.contains("unstained")


def text_date(text: Column) -> Column:
    """The date in 'Www, DD Mon YYYY ...'; null where it is none."""
    return F.call_function("try_to_date", F.substring(text, 6, 11), F.lit("dd MMM yyyy"))


def part_of_block(block_id: Column) -> Column:
    """The part number in '.../<digits>-...', or null."""
    return nonblank(F.regexp_extract(block_id, "/([0-9]+)-", 1))


def joined(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *parts)


def image_token(image_id: Column) -> Column:
    return joined("image:", image_id)


def matched_part_key(block_id: Column, image_id: Column) -> Column:
    return joined("part:", F.coalesce(part_of_block(block_id), image_token(image_id)))


def unmatched_part_key(block_id: Column, image_id: Column) -> Column:
    whole = nonblank(F.regexp_extract(block_id, "^(.+/[0-9]+)-[^/]+$", 1))
    return joined("part:unmatched:", F.coalesce(whole, joined("block:", block_id), image_token(image_id)))


def block_key(image_id: Column, *names: Column) -> Column:
    return joined("block:", F.coalesce(*names, image_token(image_id)))


def block_fields(block_id: Column, block_label: Column) -> Column:
    """struct(part int, block string, label string) from an id '.../<part>-<block>', else from the label."""
    raw = F.trim(F.regexp_extract(F.coalesce(block_id, F.lit("")), r"/(\d+)-([^/]+)$", 2))
    found = F.coalesce(block_id, F.lit("")).rlike(r"/(\d+)-([^/]+)$")
    own = F.trim(F.coalesce(block_label, F.lit("")))
    digits = lambda c: F.coalesce(nonblank(F.regexp_extract(c, r"^(\d+)", 1)), c)
    return F.struct(
        F.when(found, F.regexp_extract(block_id, r"/(\d+)-([^/]+)$", 1).try_cast("int")).alias("part"),
        F.when(found, digits(raw)).otherwise(digits(own)).alias("block"),
        F.when(found, F.trim(F.coalesce(nonblank(block_label), raw))).otherwise(nonblank(own)).alias("label"),
    )


def specimen_key(level: Column, part: Column, block: Column) -> Column:
    """block::N::B, part::N or unmatched::N::B, with ? for what is unknown."""
    n, b = F.coalesce(part.cast("string"), F.lit("?")), F.coalesce(nonblank(block), F.lit("?"))
    return F.when(level == "BLOCK", F.concat(F.lit("block::"), n, F.lit("::"), b)).when(level == "PART", joined("part::", n)).otherwise(F.concat(F.lit("unmatched::"), n, F.lit("::"), b))


def specimen_label(level: Column, part: Column, description: Column, label: Column, block: Column) -> Column:
    name = F.when(part.isNotNull(), joined("Part ", part.cast("string"))).otherwise(F.coalesce(nonblank(one_space(description)), F.lit("Specimen")))
    token = F.coalesce(nonblank(one_space(label)), nonblank(block))
    return F.when((level == "BLOCK") & token.isNotNull(), F.concat(name, F.lit(" / Block "), token)).otherwise(name)


def form_encoded(text: Column) -> Column:
    """As HTML forms encode: a space is +, * and ~ are %2A and ~."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
