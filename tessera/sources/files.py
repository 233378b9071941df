"""Readers and writers of the files around the association tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATE = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("path", T.StringType())])
RESULT = T.StructType([T.StructField(n, t) for n, t in (
    ("image_id", T.StringType()), ("source_path", T.StringType()), ("artifact_uri", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("content_type", T.StringType()),
    ("status", T.StringType()), ("rendered_at", T.TimestampType()), ("error_message", T.StringType()), ("manifest_version", T.StringType()),
)])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the driver and all executors share. Where none is set, a session on one machine makes its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written as a table under the shared folder and read back: the lineage ends there, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, "staged")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def unstaged(df: DataFrame) -> None:
    """Deletes a table that staged wrote, once all that was read from it has been written too."""
    path, fs = hadoop_path(df.sparkSession, df.table_path)
    fs.delete(path, True)


def clinical_rows(spark: SparkSession, path: str) -> DataFrame:
    """The data of a clinical TSV: '#' rows are dropped and the next row names the columns. All columns are text."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", quote="")


def clinical_ids(spark: SparkSession, path: str, column: str = "PATIENT_ID") -> DataFrame:
    """The distinct non-blank ids; an error if the file has none."""
    ids = clinical_rows(spark, path).select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()
    if ids.isEmpty():
        raise ValueError(f"{path} has no {column}")
    return ids


def ordered_ids(spark: SparkSession, path: str, column: str = "PATIENT_ID") -> DataFrame:
    """The distinct non-blank ids (id) and the place of their first row (at), which sorts as the file does."""
    names = clinical_rows(spark, path).columns
    lines = numbered(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.col("value") != "\t".join(names)))
    ids = lines.select(F.trim(F.get(F.split("value", "\t", -1), names.index(column))).alias("id"), "at").where(F.col("id") != "")
    return ids.groupBy("id").agg(F.min("at").alias("at"))


def positional_ids(spark: SparkSession, path: str, header_lines: int = 5) -> DataFrame:
    """The first column (id) of a clinical TSV after its header_lines first lines that are not blank, whatever they hold."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    # The header stands at the start of the file's first split, in the order that the split is read.
    head = lines.where(F.col("_b") == 0).orderBy("_i").limit(header_lines).agg(F.max("_i")).first()[0]
    return lines.where((F.col("_b") > 0) | (F.col("_i") > F.lit(head))).select(F.get(F.split("value", "\t", -1), 0).alias("id"))


def study_identifier(spark: SparkSession, folder: str) -> str:
    """The study id that a folder's meta file states, else the folder's name."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta_study.txt")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return name
    stated = spark.read.text(f"{folder}/meta_study.txt").where(F.col("value").startswith("cancer_study_identifier:")).first()
    return stated["value"].split(":", 1)[1].strip() if stated else name


def without_attributes(spark: SparkSession, path: str, out: str, attributes: list[str]) -> list[str]:
    """Writes a clinical TSV without some columns, its '#' rows too, and returns the columns that went. Rows are padded to the header.

    The five header rows are read alone; the data rows go through Spark."""
    lines = spark.read.text(path)
    head = [r["value"].split("\t") for r in lines.where(F.col("value").startswith("#")).limit(4).collect()]
    names = clinical_rows(spark, path).columns
    keep = [k for k, n in enumerate(names) if n not in attributes]
    gone = [n for n in names if n in attributes]
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.col("value") != "\t".join(names)))
    cells = F.split("value", "\t", -1)
    body = rows.select(F.concat_ws("\t", *[F.coalesce(F.get(cells, k), F.lit("")) for k in keep]).alias("value"))
    top = spark.createDataFrame([("\t".join(x for k, x in enumerate(h) if k in keep),) for h in [*head, names]], "value string")
    top.coalesce(1).unionByName(body.coalesce(1)).coalesce(1).write.mode("overwrite").text(out)
    return gone


def clean_study(spark: SparkSession, folder: str, out: str, attributes: list[str], stale: list[str], name: str = "data_clinical_sample.txt") -> dict[str, list[str]]:
    """Takes attributes out of a study's clinical file, whose new form goes to out, and deletes the listed files of the study that are there.

    Returns the columns and the files that went. Paths that lead out of the study are an error before anything is done."""
    path, fs = hadoop_path(spark, f"{folder.rstrip('/')}/{name}")
    if bad := [x for x in stale if x.startswith("/") or ".." in x.split("/") or ":" in x or not x]:
        raise ValueError(f"not files of the study: {bad}")
    gone = without_attributes(spark, path.toString(), out, attributes) if fs.exists(path) else []
    deleted = []
    for x in stale:
        old, own = hadoop_path(spark, f"{folder.rstrip('/')}/{x}")
        if own.exists(old) and own.getFileStatus(old).isFile() and own.delete(old, False):
            deleted.append(x)
    return {"removed_attributes": gone, "removed_files": deleted}


def write_tsv(df: DataFrame, path: str, order: list[Column], hidden: tuple[str, ...] = ()) -> None:
    """One TSV with a header row, in an order: for small study files. Hidden columns are for the order only."""
    df.orderBy(*order).drop(*hidden).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_meta(spark: SparkSession, path: str, fields: dict[str, str]) -> None:
    spark.createDataFrame([(f"{k}: {v}",) for k, v in fields.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of renderers; truncated lines and lines without an image go."""
    rows = spark.read.schema(RESULT).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.coalesce(F.trim("image_id"), F.lit("")) != "")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their place (file, start of the split, order in it), which sorts as the lines stand."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, study: str | None = None) -> DataFrame:
    """One line for each (study_id, patient_id) with its slides, of one study where that is named. Blank lines are skipped; malformed lines
    and blank ids are errors that name the first such line, and so are repeated patients and files without rows."""
    read = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    lines = numbered(spark, path)
    rows = lines.where(F.trim("value") != "").select("at", F.from_json("value", read, options).alias("r")).select("at", "r.*")
    blank = (F.coalesce(F.trim("study_id"), F.lit("")) == "") | (F.coalesce(F.trim("patient_id"), F.lit("")) == "") | F.col("slides").isNull()
    seen = rows.agg(F.count("*").alias("n"), F.min(F.when(F.col("_malformed").isNotNull() | blank, F.col("at"))).alias("bad")).first()
    if not seen["n"]:
        raise ValueError("the snapshot has no rows")
    if seen["bad"] is not None:
        first = F.struct(*[F.lit(x).alias(c) for x, c in zip(seen["bad"], "fbi")])
        before = lines.where((F.col("at.f") == seen["bad"]["f"]) & (F.col("at") < first)).count()
        raise ValueError(f"{seen['bad']['f']}, line {before + 1}: malformed, or without study, patient or slides")
    if not rows.groupBy("study_id", "patient_id").count().where("count > 1").isEmpty():
        raise ValueError("a patient has two lines")
    own = rows.select(*schema.fieldNames())
    return own if study is None else own.where(F.col("study_id") == study)


def write_snapshot(associations: DataFrame, study: str | Column, path: str) -> None:
    """One JSON line for each patient, with its slides by image, in gzip files. study: an id, or a column over patient_id. The rows are dealt by
    ranges of patients before their lines are made, so they move once and no line does."""
    columns = [c for c in associations.columns if c not in ("patient_id", "updated_at")]
    slides = F.array_sort(F.collect_list(F.struct("image_id", *[c for c in columns if c != "image_id"]))).alias("slides")
    lines = associations.repartitionByRange("patient_id").groupBy("patient_id").agg(slides).select(F.lit(study).alias("study_id"), "patient_id", "slides")
    lines.sortWithinPartitions("patient_id").write.mode("overwrite").option("compression", "gzip").json(path)


ENTRY = "struct<uri:string,width:int,height:int,content_type:string,source_uri:string>"


def manifest_entries(rows: DataFrame) -> DataFrame:
    """image_id and the fields of entries (s) under a master size (m): entries without a uri go, sizes are at least 1."""
    e = rows.where(F.coalesce(F.col("s.uri"), F.lit("")) != "")
    side = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(f"s.{c}"), F.col("m"))).alias(c)
    return e.select("image_id", "s.uri", side("width"), side("height"), F.coalesce("s.content_type", F.lit("image/jpeg")).alias("content_type"), "s.source_uri")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """image_id, uri, width, height, content_type and source_uri of a thumbnail manifest; entries without a uri go, sizes are at least 1."""
    rows = spark.read.schema(f"version int, manifest_version string, master_size int, slides map<string,{ENTRY}>").option("multiLine", True).json(path)
    return manifest_entries(rows.select(F.coalesce("master_size", F.lit(512)).alias("m"), F.explode("slides").alias("image_id", "s")))


def index_revision(spark: SparkSession, path: str) -> str:
    """The revision of an index file: it changes with its bytes."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 16)).first()[0]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The resource index of a version 2 file in long form: study_id, resource_type, resource_id, patient_id, source_path. A file that is
    malformed, has another version, or binds a slide to no patient is an error."""
    study = "struct<patients:array<string>,samples:array<string>,slides:map<string,struct<patient_id:string,source_path:string>>>"
    raw = spark.read.schema(f"version int, studies map<string,{study}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not raw.where((F.col("version") == 2) & F.col("studies").isNotNull()).take(1):
        raise ValueError(f"{path} is no index of version 2")
    own = raw.select(F.explode("studies").alias("study_id", "s"))
    if not own.where(F.col("s.slides").isNull()).isEmpty():
        raise ValueError("a study has no slide bindings")
    slides = own.select("study_id", F.explode("s.slides").alias("resource_id", "b"))
    if not slides.where(F.coalesce("b.patient_id", F.lit("")) == "").isEmpty():
        raise ValueError("a slide is bound to no patient")
    none = F.lit(None).cast("string")
    ids = lambda kind: own.select("study_id", F.lit(kind).alias("resource_type"), F.explode(f"s.{kind}s").alias("resource_id"), none.alias("patient_id"), none.alias("source_path")).distinct()
    return ids("patient").unionByName(ids("sample")).unionByName(slides.select("study_id", F.lit("slide").alias("resource_type"), "resource_id", "b.patient_id", "b.source_path"))


def hadoop_path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that a published folder's pointer names, or none."""
    pointer, fs = hadoop_path(spark, f"{path.rstrip('/')}/_current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def set_current_version(spark: SparkSession, path: str, version: str | None) -> None:
    """Moves a pointer that is written beside over the old one in one step; without a version the pointer goes."""
    pointer, fs = hadoop_path(spark, f"{path.rstrip('/')}/_current")
    if version is None:
        fs.delete(pointer, False)
        return
    fresh, _ = hadoop_path(spark, f"{path.rstrip('/')}/_current-{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.writeUTF(version)
    stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    to = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    to.rename(fresh, pointer, options)


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Writes a version beside the current one, compares the rows that were written with those that can be read, and switches the pointer in
    one step: readers see the old or the new rows, and a crash leaves the old ones. Older versions stay until they are cleared."""
    spark, version, seen = df.sparkSession, fresh_version(), Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd")
    (out.partitionBy(partition) if partition else out).parquet(f"{path.rstrip('/')}/{version}")
    if spark.read.parquet(f"{path.rstrip('/')}/{version}").count() != seen.get["n"]:
        raise ValueError(f"not all rows of {path} can be read back")
    set_current_version(spark, path, version)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{current_version(spark, path)}")


def write_candidates(candidates: DataFrame, path: str, limit: int | None = None) -> None:
    """Candidates as JSON lines, by image; with a limit the first ones only."""
    own = candidates.select("image_id", "path").orderBy("image_id", "path")
    (own if limit is None else own.limit(limit)).write.mode("overwrite").json(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """image_id and path of candidate lines; a malformed line is an error, and lines without an image or a path go."""
    rows = spark.read.schema(CANDIDATE).option("mode", "FAILFAST").json(path)
    return rows.where((F.coalesce(F.trim("image_id"), F.lit("")) != "") & (F.coalesce(F.trim("path"), F.lit("")) != ""))


def write_release(tables: dict[str, DataFrame], folder: str, release: str) -> None:
    """The tables of a release, which nobody reads before mark_release."""
    for name, df in tables.items():
        df.drop("release_id").write.mode("overwrite").parquet(f"{folder}/{name}/release_id={release}")


def mark_release(studies: DataFrame, folder: str, release: str, version: int = 1) -> None:
    """A marker for each study (cancer_study_id) of a release: from here on readers see it."""
    studies.select("cancer_study_id", F.lit(release).alias("release_id"), F.lit(version).alias("release_version"), F.current_timestamp().alias("released_at")).coalesce(1).write.mode("append").parquet(f"{folder}/release")


def publish_release(tables: dict[str, DataFrame], folder: str, release: str) -> None:
    """Appends the tables of a release and its marker last; readers take releases that have one."""
    write_release(tables, folder, release)
    mark_release(next(iter(tables.values())).sparkSession.range(1).select(F.lit(None).cast("long").alias("cancer_study_id")), folder, release)


def read_release(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of the latest complete release."""
    latest = spark.read.parquet(f"{folder}/release").orderBy(F.col("released_at").desc(), F.col("release_id").desc()).first()["release_id"]
    return spark.read.parquet(f"{folder}/{name}").where(F.col("release_id") == latest)
