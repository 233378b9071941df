"""A snapshot of slides becomes a release: validators over its rows, internal ids by joins, then the tables, the index and, last, the marker."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators.relational import first_by, missing
from tessera.plans import serving
from tessera.plans.canonical import Canonical
from tessera.sources import documents, files

PATIENT = ["study_id", "patient_id"]
SAMPLE = [*PATIENT, "sample_id"]
PART = ["part_number", "part_designator", "part_type", "part_description", "subspecialty", "path_dx_title"]
SLIDE = ["stain_name", "stain_group", "is_hne", "is_ihc", "magnification", "file_size_bytes", "can_serve_tiles", "barcode", "slide_type"]
PLACE = ["part_key", "block_key", "sample_id", "match_level", "specimen_key", "procedure_date_days", "timepoint_source"]
HOMED = ["slide", "placement"]  # tables with a row a slide, in any order
WANTED = ["image_id", "slide_path", "reference_sample_id", "block_number", "block_label", *PLACE, *PART, *SLIDE]


def release_id() -> str:
    """Nanoseconds, padded so that later ids sort later, and a random part."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _named(c: Column) -> Column:
    """A sample id; '' and UNMATCHED name none."""
    return F.when(~c.isin("", "UNMATCHED"), c)


def slide_rows(snapshot: DataFrame) -> DataFrame:
    """A row for each slide of snapshot lines (study_id, patient_id, slides), with its position in the line. Columns that slides lack are null."""
    known = snapshot.schema["slides"].dataType.elementType.fieldNames()
    flat = snapshot.select(*PATIENT, F.posexplode("slides").alias("position", "s"))
    text = lambda c: F.col(f"s.{c}") if c in known else F.lit(None).cast("string")
    return flat.select(*PATIENT, "position", *[text(c).alias(c) for c in WANTED])


def _boolean(c: str) -> Column:
    text = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def violations(rows: DataFrame, patients: DataFrame, samples: DataFrame, associations: DataFrame | None = None, near: list[str] | None = None, stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rule and n for every rule over slide_rows.

    patients: study_id, patient_id and internal ids; samples: study_id, patient_id, sample_id and an internal id. associations
    (study_id, patient_id, image_id, sample_id), where kept apart from the slides, must fit them one to one. near: columns that an image determines,
    by which rows lie already, so that none moves; then stage keeps what the other rules read, names and flags, and rows are read once."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    level = F.upper(F.coalesce("match_level", F.lit("")))
    given = lambda c: F.col(c).isNotNull() & _boolean(c).isNull()
    no_sample = F.coalesce("sample_id", F.lit("")) == ""
    by_row = {
        "no_image": F.col("image_id").isNull(), "bad_part_key": blank("part_key") | F.col("part_key").contains("?"), "bad_block_key": blank("block_key") | F.col("block_key").contains("?"),
        "bad_level": ~level.isin("BLOCK", "PART", "UNMATCHED"), "no_specimen": blank("specimen_key"), "bad_boolean": _boolean("can_serve_tiles").isNull() | given("is_hne") | given("is_ihc"),
        "servable_without_path": _boolean("can_serve_tiles") & ~F.coalesce(F.col("slide_path").startswith("s3://"), F.lit(False)),
        "unmatched_with_sample": (level == "UNMATCHED") & ~no_sample, "matched_without_sample": (level != "UNMATCHED") & no_sample,
    }
    differ = lambda columns, over: over(F.min(F.struct(*columns))) != over(F.max(F.struct(*columns)))
    of_slide = lambda over: {"duplicate_association": over(F.count("*")) > 1, "conflicting_slide": differ(SLIDE, over), "conflicting_placement": differ(PLACE, over), "association_of_other_sample": differ(["sample_id"], over)}
    of_binding = lambda over: {"conflicting_binding": differ(["patient_id", "slide_path"], over)}
    out = []
    several = lambda counts: out.append(counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in counts.columns])).alias("r")).select("r.*"))
    number = lambda rule, df: several(df.agg(F.count("*").alias(rule)))
    kept, rules = rows, {k: X.either(c) for k, c in by_row.items()}
    for keys, of_group in (([*PATIENT, "image_id"], of_slide), (["study_id", "image_id"], of_binding)):
        if near:  # told where the rows lie, the first of a group stands for it
            group = Window.partitionBy(*near, *keys)
            found = of_group(lambda c, group=group: c.over(group))
            kept = kept.withColumns({k: c & (F.row_number().over(group.orderBy("image_id")) == 1) for k, c in found.items()})
            rules |= {k: F.col(k) for k in found}
        else:
            found = of_group(lambda c: c)
            several(rows.groupBy(*keys).agg(*[c.alias(k) for k, c in found.items()]).agg(*[F.count_if(k).alias(k) for k in found]))
    kept = kept.select(*PATIENT, "sample_id", "reference_sample_id", *[c.alias(k) for k, c in rules.items()])
    kept = stage(kept) if stage else kept
    several(kept.agg(*[F.count_if(k).alias(k) for k in rules]))
    reference = kept.select(*PATIENT, _named(F.col("reference_sample_id")).alias("sample_id")).dropna().distinct()
    number("several_references", reference.groupBy(*PATIENT).count().where("count > 1"))
    wanted = kept.select(*PATIENT, _named(F.col("sample_id")).alias("sample_id")).dropna().unionByName(reference).distinct()
    number("unknown_patient", missing(kept, patients, PATIENT))
    stands = wanted.join(samples.groupBy(*SAMPLE).agg(F.count("*").alias("k")), SAMPLE, "left")
    several(stands.agg(F.count_if(F.col("k").isNull()).alias("unknown_sample"), F.count_if(F.col("k") > 1).alias("ambiguous_sample")))
    if associations is not None:
        keys = [*PATIENT, "image_id"]
        number("orphan_association", missing(associations, rows, keys))
        theirs = associations.select(*keys, _named(F.col("sample_id")).alias("a"))
        number("association_of_other_sample_apart", rows.join(theirs, keys).where(F.col("a").isNotNull() & ~F.col("a").eqNullSafe(_named(F.col("sample_id")))))
    return reduce(DataFrame.unionByName, out)


class Load:
    """The tables of a release, from slide rows that broke no rule. Each looks up no more names than it needs."""

    def __init__(self, rows: DataFrame, patients: DataFrame, samples: DataFrame, join: Callable[..., DataFrame] = DataFrame.join) -> None:
        """patients: study_id, patient_id, study_internal_id, patient_internal_id; samples: study_id, patient_id, sample_id, sample_internal_id. join: DataFrame.join or what gives its rows."""
        self._samples, self._join = samples, join
        own = rows.withColumn("sample_id", _named(F.col("sample_id"))).withColumn("reference_sample_id", _named(F.col("reference_sample_id")))
        # Samples come in the order of their first slides, and slides of a sample in theirs: what repeats a key is dropped in this order.
        own = own.withColumn("sample_position", F.min("position").over(Window.partitionBy(*SAMPLE)))
        self.of_patients = join(own, patients, PATIENT).withColumn("cancer_study_id", F.col("study_internal_id"))

    def _first(self, keys: list[str], columns: list[str]) -> DataFrame:
        """Rows lie by their patient from the start, whose names stand among the keys, so that they move once; no sample is looked up."""
        ids = ["cancer_study_id", "patient_internal_id", *keys]
        return first_by(self.of_patients, [*PATIENT, *ids], [F.col("sample_position"), F.col("position")]).select(*ids, *columns)

    def part(self) -> DataFrame:
        return self._first(["part_key"], PART)

    def block(self) -> DataFrame:
        return self._first(["part_key", "block_key"], ["block_number", "block_label"])

    def slide(self) -> DataFrame:
        flag = lambda c: F.coalesce(_boolean(c), F.lit(False)).alias(c) if c in ("is_hne", "is_ihc", "can_serve_tiles") else F.col(c)
        return self.of_patients.select("cancer_study_id", "patient_internal_id", "image_id", *[flag(c) for c in SLIDE])

    def placement(self) -> DataFrame:
        own = self._join(self.of_patients, self._samples, SAMPLE, "left")
        return own.select("cancer_study_id", "patient_internal_id", "image_id", "part_key", "block_key", "sample_internal_id", F.upper("match_level").alias("match_level"), "specimen_key", "procedure_date_days", "timepoint_source")

    def patient(self) -> DataFrame:
        references = self._samples.select(*PATIENT, F.col("sample_id").alias("reference_sample_id"), F.col("sample_internal_id").alias("reference_internal_id"))
        own = self._join(self.of_patients, references, [*PATIENT, "reference_sample_id"], "left")
        return own.groupBy("cancer_study_id", "patient_internal_id").agg(F.max("reference_internal_id").alias("reference_sample_internal_id"))

    def index(self) -> DataFrame:
        """The resources of the loaded studies in long form."""
        none = F.lit(None).cast("string")
        entry = lambda kind, key, patient=none, path=none: F.struct(F.lit(kind).alias("resource_type"), F.col(key).alias("resource_id"), patient.alias("patient_id"), path.alias("source_path"))
        each = F.array(entry("patient", "patient_id"), entry("sample", "sample_id"), entry("sample", "reference_sample_id"), entry("slide", "image_id", F.col("patient_id"), F.col("slide_path")))
        return self.of_patients.select("study_id", F.explode(each).alias("e")).select("study_id", "e.*").where(F.col("resource_id").isNotNull()).distinct()


def load_release(spark: SparkSession, snapshot: DataFrame, patients: DataFrame, samples: DataFrame, folder: str, version: int, index_path: str | None = None, waived: tuple[str, ...] = ()) -> str:
    """Checks a snapshot, and only if no rule but the waived ones is broken writes its tables under folder, publishes the index with the loaded
    studies in place of their old entries, and writes the marker that makes the release visible. If the marker fails, the index of before is
    put back. Returns the release id."""
    if version < 1:
        raise ValueError("version must be positive")
    # The rules, five tables and the index all read the rows: the snapshot is parsed once, and each reads its own columns of the table.
    rows = files.staged(slide_rows(snapshot))
    try:
        broken = [f"{r['rule']}: {r['n']}" for r in violations(rows, patients, samples).where("n > 0").collect() if r["rule"] not in waived]
        if broken:
            raise ValueError("the snapshot breaks rules: " + ", ".join(sorted(broken)))
        return _write(spark, Load(rows, patients, samples), folder, version, index_path)
    finally:
        files.unstaged(rows)


def _write(spark: SparkSession, load: Load, folder: str, version: int, index_path: str | None) -> str:
    release = release_id()
    tables = {"part": load.part(), "block": load.block(), "slide": load.slide(), "placement": load.placement(), "patient": load.patient()}
    files.write_release(tables, folder, release)
    before = files.current_version(spark, index_path) if index_path else None
    if index_path:
        fresh = load.index()
        old = documents.read_index_document(spark, documents.current_document(spark, index_path)) if before else None
        documents.publish_index_document(serving.index_merge(old, fresh) if before else fresh, index_path)
    try:
        files.mark_release(tables["patient"].select("cancer_study_id").distinct(), folder, release, version)
    except Exception:
        if index_path:
            files.set_current_version(spark, index_path, before)
        raise
    return release


def snapshot_of(c: Canonical) -> DataFrame:
    """The associations as snapshot lines whose slides stand in falling order of image id."""
    columns = [x for x in c.associations.columns if x not in ("patient_id", "association_version", "updated_at")]
    slides = F.sort_array(F.collect_list(F.struct("image_id", *[x for x in columns if x != "image_id"])), asc=False).alias("slides")
    return c.associations.groupBy("patient_id").agg(slides).select(_study().alias("study_id"), "patient_id", "slides")


def _study() -> Column:
    return F.concat(F.lit("study_"), F.substring("patient_id", 3, 7).cast("int") % 3)


def rows_of(c: Canonical) -> DataFrame:
    """slide_rows of snapshot_of, without making the lines: places by a window, so that only the columns that are asked for are shuffled."""
    place = F.row_number().over(Window.partitionBy(*PATIENT).orderBy(F.col("image_id").desc())) - 1  # a patient is in one study; rows then lie as joins want them
    return c.associations.withColumn("study_id", _study()).select(*PATIENT, place.alias("position"), *WANTED)


def homed_rows_of(c: Canonical) -> DataFrame:
    """rows_of where they lie by home, for what needs no places."""
    return c.homed.withColumn("study_id", _study()).select("home", *PATIENT, F.lit(None).cast("int").alias("position"), *WANTED)


def join_at_home(c: Canonical) -> Callable[..., DataFrame]:
    """DataFrame.join for homed_rows_of, by keys among SAMPLE: the names of each home are looked up and come back as one row a home, so that slides
    with their texts do not move."""
    names = c.names.withColumn("study_id", _study())

    def join(rows: DataFrame, known: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        values = [x for x in known.columns if x not in keys]
        found = c.roles.laid(names.select("home", *keys).distinct().join(known, keys), "home").groupBy("home").agg(F.collect_list(F.struct(*keys, *values)).alias("_known"))
        mine = F.filter("_known", lambda x: reduce(and_, [x[k] == F.col(k) for k in keys]))
        each = F.explode_outer if how == "left" else F.explode
        return rows.join(found, "home", "left").select(*rows.columns, each(mine).alias("_own")).select(*rows.columns, *[F.col(f"_own.{x}") for x in values])

    return join


def identities_of(c: Canonical, gaps: bool) -> tuple[DataFrame, DataFrame]:
    """Patients and samples with internal ids. With gaps some are unknown and some samples stand twice, so that the rules have work."""
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    name = lambda k: F.concat(F.lit("P-"), F.lpad(k.cast("string"), 7, "0"))
    study = lambda k: F.concat(F.lit("study_"), (k % 3).cast("string"))
    patients = c.roles.table("customer").where(key % 29 != 0 if gaps else F.lit(True)).select(
        study(key).alias("study_id"), name(key).alias("patient_id"), (key % 3 + 1).alias("study_internal_id"), (key + 1_000_000).alias("patient_internal_id"))
    owner = F.col("o_custkey")
    samples = c.roles.table("orders").where(order % 31 != 0 if gaps else F.lit(True)).select(
        study(owner).alias("study_id"), name(owner).alias("patient_id"), F.concat(name(owner), F.lit("-T"), order.cast("string")).alias("sample_id"), (order + 5_000_000).alias("sample_internal_id"))
    twice = samples.where(F.col("sample_internal_id") % 37 == 0).withColumn("sample_internal_id", -F.col("sample_internal_id"))
    return patients, samples.unionByName(twice) if gaps else samples


def loaded(c: Canonical, table: str) -> DataFrame:
    identities = identities_of(c, False)
    if table in HOMED and c.homed is not None:
        return getattr(Load(homed_rows_of(c), *identities, join_at_home(c)), table)()
    return getattr(Load(rows_of(c), *identities), table)()


def load_violations(c: Canonical) -> DataFrame:
    identities = identities_of(c, True)
    if c.homed is None:
        return violations(c.stage(rows_of(c)), *identities)
    return violations(homed_rows_of(c), *identities, near=["home"], stage=c.stage)
