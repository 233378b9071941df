"""JSON documents of any size: written as sorted lines by many tasks, joined by the file system, read back by lines.

Each line is a piece of the document (an opening, an item with the comma before it, a closing), so no task and no row holds more than
one item, and a reader that splits the file finds its place from the openings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import files

_HEAD = '{"version":2,"studies":{'
_OPENS = r'^,?(".*"):\{"patients":\[$'
_SAMPLES, _SLIDES, _END = '],"samples":[', '],"slides":{', "}}"
INDEX = ["study_id", "resource_type", "resource_id", "patient_id", "source_path"]


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    made = F.to_json(F.struct(text.alias("v")))
    return F.substring(made, 6, F.length(made) - 6)


def _joined(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder as one file, in order, through buffers of 64 KiB in the JVM: a stream of bytes, never the document."""
    target, fs = files.hadoop_path(spark, path)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(files.hadoop_path(spark, folder)[0]) if s.getPath().getName().startswith("part-") and s.getLen())
    out = fs.create(target, True)
    try:
        for part in parts:
            source = fs.open(files.hadoop_path(spark, part)[0])
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(files.hadoop_path(spark, folder)[0], True)


def publish_document(lines: DataFrame, order: list[str], path: str) -> str:
    """Publishes lines (text, and columns of a total order) as one document under path/<version>/document.json and returns the version.

    The lines are sorted by ranges and written in parallel. The document is read back and compared with what was to be written (lines,
    characters, and the parity of their hashes) before the pointer is switched: after a failure at any step the old document stays."""
    spark, seen, version = lines.sparkSession, Observation(), files.fresh_version()
    folder = f"{path.rstrip('/')}/{version}"
    sums = lambda c: [F.count(F.lit(1)).alias("n"), F.sum(F.length(c)).alias("length"), F.bit_xor(F.xxhash64(c)).alias("parity")]
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = lines.repartitionByRange(*by).sortWithinPartitions(*by).select("text")
    ranged.observe(seen, *sums(F.col("text"))).write.text(f"{folder}.parts")
    _joined(spark, f"{folder}.parts", f"{folder}/document.json")
    back = spark.read.text(f"{folder}/document.json").agg(*sums(F.col("value"))).first()
    if back.asDict() != {k: seen.get[k] for k in ("n", "length", "parity")}:
        raise ValueError(f"the document of {path} cannot be read back as it was written")
    files.set_current_version(spark, path, version)
    return version


def current_document(spark: SparkSession, path: str) -> str:
    return f"{path.rstrip('/')}/{files.current_version(spark, path)}/document.json"


def index_lines(index: DataFrame) -> tuple[DataFrame, list[str]]:
    """The lines of the document of an index in long form (study_id, resource_type, resource_id, patient_id, source_path), and their order."""
    rows = index.select(INDEX).distinct()
    least = rows.groupBy("study_id", "resource_type").agg(F.min("resource_id").alias("_least"))
    kind = F.col("resource_type")
    comma = F.when(F.col("resource_id") == F.col("_least"), "").otherwise(",")
    binding = F.concat(F.lit(":"), F.to_json(F.struct("patient_id", "source_path")))
    text = F.concat(comma, _quoted(F.col("resource_id")), F.when(kind == "slide", binding).otherwise(""))
    place = F.when(kind == "patient", 1).when(kind == "sample", 3).otherwise(5)
    items = rows.join(least, ["study_id", "resource_type"]).select(F.lit(1).alias("k0"), F.col("study_id").alias("k1"), place.alias("k2"), F.col("resource_id").alias("k3"), text.alias("text"))
    studies = least.select("study_id").distinct()
    first = studies.agg(F.min("study_id").alias("_first"))
    opening = F.concat(F.when(F.col("study_id") == F.col("_first"), "").otherwise(","), _quoted(F.col("study_id")), F.lit(':{"patients":['))
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("k2"), t.alias("text")) for k, t in ((0, opening), (2, F.lit(_SAMPLES)), (4, F.lit(_SLIDES)), (6, F.lit(_END)))]))
    frames = studies.join(F.broadcast(first)).select("study_id", marks.alias("m")).select(F.lit(1).alias("k0"), F.col("study_id").alias("k1"), "m.k2", F.lit("").alias("k3"), "m.text")  # one row is broadcast
    ends = index.sparkSession.createDataFrame([(0, "", 0, "", _HEAD), (2, "", 0, "", _END)], frames.schema)
    return items.unionByName(frames).unionByName(ends), ["k0", "k1", "k2", "k3"]


def publish_index_document(index: DataFrame, path: str) -> str:
    lines, order = index_lines(index)
    return publish_document(lines, order, path)


def read_index_document(spark: SparkSession, path: str) -> DataFrame:
    """The long form of an index document written by lines. Splits of the file are read apart; the study and list that a line stands in
    come from the last opening before it, within its split or carried from the splits before, which is one row a split. A document that
    is cut off, has another version, or holds a malformed line or a slide without a patient is an error."""
    lines = files.numbered(spark, path).select(F.col("at.b").alias("b"), F.col("at.i").alias("i"), F.col("value").alias("text"))
    text = F.col("text")
    opens, mark = text.rlike(_OPENS), F.when(text.rlike(_OPENS), "patient").when(text == _SAMPLES, "sample").when(text == _SLIDES, "slide").when(text == _END, "none").when(text == _HEAD, "none")
    marked = lines.withColumn("mark", mark).withColumn("study", F.when(opens, F.regexp_extract("text", _OPENS, 1)))
    seen = marked.agg(F.count_if(text == _HEAD).alias("heads"), F.count_if(opens).alias("opened"), F.count_if(text == _END).alias("ended")).first()
    if seen["heads"] != 1 or seen["ended"] != seen["opened"] + 1:
        raise ValueError(f"{path} is no whole index of version 2")
    own = Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True)
    placed = marked.select("b", "text", "mark", last("mark").over(own).alias("kind"), last("study").over(own).alias("in_study")).where(F.col("mark").isNull())
    by_split = marked.groupBy("b").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("i"))).alias("_kind"), F.max_by("study", F.when(F.col("study").isNotNull(), F.col("i"))).alias("_study"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    carried = by_split.select("b", last("_kind").over(before).alias("_kind"), last("_study").over(before).alias("_study"))
    rows = placed.join(carried, "b", "left").select(F.coalesce("kind", "_kind").alias("resource_type"), F.coalesce("in_study", "_study").alias("study"), F.regexp_replace("text", "^,", "").alias("text"))
    strict = {"mode": "FAILFAST"}
    scalar = lambda c: F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string", strict)["v"]
    binding = F.from_json(F.concat(F.lit('{"m":{'), F.col("text"), F.lit("}}")), "m map<string,struct<patient_id:string,source_path:string>>", strict)["m"]
    none = F.lit(None).cast("string")
    ids = rows.where(F.col("resource_type").isin("patient", "sample")).select(scalar(F.col("study")).alias("study_id"), "resource_type", scalar(F.col("text")).alias("resource_id"), none.alias("patient_id"), none.alias("source_path"))
    slides = rows.where(~F.col("resource_type").isin("patient", "sample")).select(scalar(F.col("study")).alias("study_id"), "resource_type", F.explode(binding).alias("resource_id", "e"))
    bound = F.when(F.coalesce("e.patient_id", F.lit("")) == "", F.raise_error(F.lit("a slide is bound to no patient")).cast("string")).otherwise(F.col("e.patient_id"))
    return ids.unionByName(slides.select("study_id", "resource_type", "resource_id", bound.alias("patient_id"), "e.source_path"))


def publish_manifest(entries: DataFrame, path: str, manifest_version: str, master_size: int, generated_at: str) -> str:
    """Publishes a thumbnail manifest of entries (image_id and the fields of an entry), one for each image, by image."""
    head = '{{"version":1,"manifest_version":{},"generated_at":{},"master_size":{},"slides":{{'
    fields = [c for c in entries.columns if c != "image_id"]
    least = entries.agg(F.min("image_id").alias("_least"))
    items = entries.join(F.broadcast(least)).select(  # one row is broadcast
        F.lit(1).alias("k0"), F.col("image_id").alias("k1"),
        F.concat(F.when(F.col("image_id") == F.col("_least"), "").otherwise(","), _quoted(F.col("image_id")), F.lit(":"), F.to_json(F.struct(*fields))).alias("text"))
    ends = entries.sparkSession.createDataFrame([(0, "", head.format(json.dumps(manifest_version), json.dumps(generated_at), int(master_size))), (2, "", _END)], items.schema)
    return publish_document(items.unionByName(ends), ["k0", "k1"], path)


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest written by lines, under the rules of files.manifest_entries. A document without its head or end is an error."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith('{"version":1,')).select(F.from_json(F.concat("value", F.lit(_END)), "version int, master_size int", {"mode": "FAILFAST"}).alias("h")).select("h.*").take(2)
    if len(head) != 1 or lines.where(F.col("value") == _END).count() != 1:
        raise ValueError(f"{path} is no whole manifest of version 1")
    item = F.concat(F.lit('{"m":{'), F.regexp_replace("value", "^,", ""), F.lit("}}"))
    own = lines.where(F.col("value").startswith('"') | F.col("value").startswith(',"')).select(F.explode(F.from_json(item, f"m map<string,{files.ENTRY}>", {"mode": "FAILFAST"})["m"]).alias("image_id", "s"))
    return files.manifest_entries(own.withColumn("m", F.lit(512 if head[0]["master_size"] is None else head[0]["master_size"])))
