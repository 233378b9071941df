"""Documents written by lines: their bytes, their readers, their publishing."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.plans import serving
from tessera.sources import documents, files

ROWS = [
    ("s2", "patient", "P-2", None, None), ("s2", "patient", "P-1", None, None), ("s2", "patient", "P-1", None, None), ("s2", "sample", 'x":{"patients":[', None, None), ("s2", "slide", "7", "P-1", "s3://a"), ("s2", "slide", "10", "P-1", None),
    ('s"1', "patient", "ß\n\\", None, None), ('s"1', "slide", "}}", "P", '],"slides":{'), ("s3", "sample", "only", None, None),
]
SCHEMA = "study_id string, resource_type string, resource_id string, patient_id string, source_path string"


def text_of(spark, path):
    return open(documents.current_document(spark, path).removeprefix("file:"), encoding="utf-8").read()


def expected_document(rows):
    out = {}
    for s, t, i, p, u in sorted(set(rows), key=lambda r: (r[0], r[1], r[2])):
        study = out.setdefault(s, {"patients": [], "samples": [], "slides": {}})
        if t == "slide":
            study["slides"][i] = {"patient_id": p} | ({"source_path": u} if u is not None else {})
        else:
            study[f"{t}s"].append(i)
    return {"version": 2, "studies": out}


def test_index_document(spark, tmp_path):
    index = spark.createDataFrame(ROWS, SCHEMA)
    documents.publish_index_document(index, str(tmp_path))
    text = text_of(spark, str(tmp_path))
    assert text.replace("\n", "") == json.dumps(expected_document(ROWS), separators=(",", ":"), ensure_ascii=False)  # the same bytes but for line ends
    back = documents.read_index_document(spark, documents.current_document(spark, str(tmp_path)))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, set(ROWS)))
    whole = files.read_index(spark, documents.current_document(spark, str(tmp_path)))
    assert sorted(map(repr, map(tuple, whole.select(back.columns).collect()))) == sorted(map(repr, set(ROWS)))


def test_large_document_in_many_parts(spark, tmp_path):
    """Lists that run over splits of the file are found again, and no plan gathers a study."""
    n = 20_000
    index = spark.range(n).select(
        F.concat(F.lit("study_"), (F.col("id") % 2).cast("string")).alias("study_id"), F.when(F.col("id") % 3 == 0, "patient").when(F.col("id") % 3 == 1, "sample").otherwise("slide").alias("resource_type"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("resource_id")).withColumn("patient_id", F.when(F.col("resource_type") == "slide", "p")).withColumn("source_path", F.lit(None).cast("string"))
    lines, _ = documents.index_lines(index)
    assert "collect" not in lines._jdf.queryExecution().optimizedPlan().toString()
    documents.publish_index_document(index, str(tmp_path))
    path = documents.current_document(spark, str(tmp_path))
    json.loads(text_of(spark, str(tmp_path)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        back = documents.read_index_document(spark, path)
        assert back.count() == n and back.exceptAll(index).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_documents(spark, tmp_path):
    documents.publish_index_document(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "i"))
    good = text_of(spark, str(tmp_path / "i"))
    cases = {"cut": good[: len(good) // 2], "end": good.rstrip().removesuffix("}}"), "version": good.replace('"version":2', '"version":3'), "item": good.replace('"P-2"', '"P-2'), "patient": good.replace('"patient_id":"P-1"', '"patient_id":""'), "empty": ""}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            documents.read_index_document(spark, str(tmp_path / name)).collect()


def test_publish_survives_a_crash_at_each_step(spark, tmp_path, monkeypatch):
    path, old, new = str(tmp_path / "p"), spark.createDataFrame(ROWS[:3], SCHEMA), spark.createDataFrame(ROWS, SCHEMA)
    documents.publish_index_document(old, path)
    before, text = files.current_version(spark, path), text_of(spark, path)

    def lost(*_):
        raise OSError("lost")

    def shortened(s, folder, to):
        joined(s, folder, to)
        out = files.hadoop_path(s, to)
        out[1].delete(out[0], False)
        stream = out[1].create(out[0], True)
        stream.writeBytes("x\n")
        stream.close()

    joined = documents._joined
    for name, what in (("_joined", lost), ("_joined", shortened), ("files.set_current_version", lost)):
        with monkeypatch.context() as m:
            m.setattr(f"tessera.sources.documents.{name}", what)
            with pytest.raises((OSError, ValueError)):
                documents.publish_index_document(new, path)
        assert files.current_version(spark, path) == before and text_of(spark, path) == text
    documents.publish_index_document(new, path)
    assert files.current_version(spark, path) != before
    documents.publish_index_document(new.where("false"), path)
    assert json.loads(text_of(spark, path)) == {"version": 2, "studies": {}}


def test_manifest_document(spark, tmp_path):
    rows = [("b", "u", 5, 0, None, "s"), ("a", "v", None, 3, "image/png", None), ('q"', None, 1, 1, None, None)]
    entries = spark.createDataFrame(rows, "image_id string, uri string, width int, height int, content_type string, source_uri string")
    documents.publish_manifest(entries, str(tmp_path), 'v"1', 64, "2025-01-01T00:00:00")
    made = json.loads(text_of(spark, str(tmp_path)))
    assert list(made["slides"]) == ["a", "b", 'q"'] and made["manifest_version"] == 'v"1' and made["master_size"] == 64 and made["version"] == 1
    path = documents.current_document(spark, str(tmp_path))
    expected = [("a", "v", 64, 3, "image/png", None), ("b", "u", 5, 1, "image/jpeg", "s")]
    assert sorted(map(tuple, documents.read_manifest_document(spark, path).collect())) == expected == sorted(map(tuple, files.read_manifest(spark, path).collect()))
    documents.publish_manifest(entries.where("false"), str(tmp_path), "2", 64, "")
    assert documents.read_manifest_document(spark, documents.current_document(spark, str(tmp_path))).isEmpty()
    assert serving.INDEX == documents.INDEX
