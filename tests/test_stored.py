"""What rows alone do not show: order in files, line numbers of errors, time limits, levels of irregular pyramids."""

import time

import pytest
from pyspark.sql import functions as F
from tessera.plans import geometry
from tessera.sources import files, statements

SCHEMA = "study_id string, patient_id string, slides array<struct<image_id:string>>"


def test_snapshot_errors_name_the_line(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    good, path = '{"study_id": "s", "patient_id": "%s", "slides": []}', tmp_path / "s.json"
    path.write_text("\n".join([good % "a", "", good % "b", ""]))
    assert sorted(r.patient_id for r in files.read_snapshot(spark, str(path), schema).collect()) == ["a", "b"]
    assert files.read_snapshot(spark, str(path), schema, "other").isEmpty()
    for line in ('{"study_id": "s", "patient', good % " ", '{"study_id": "s", "patient_id": "c"}', "[1"):
        path.write_text("\n".join([good % "a", "", good % "b", line, good % "d", good % ""]))
        with pytest.raises(ValueError, match="line 4"):
            files.read_snapshot(spark, str(path), schema)
    for text in ("", "\n \n"):
        path.write_text(text)
        with pytest.raises(ValueError, match="no rows"):
            files.read_snapshot(spark, str(path), schema)
    path.write_text("\n".join([good % "a", good % "a"]))
    with pytest.raises(ValueError, match="two lines"):
        files.read_snapshot(spark, str(path), schema)


def test_ids_keep_the_order_of_the_file(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("#x\ty\nPATIENT_ID\tN\nP9\t1\n \t2\nP2\t3\nP9\t4\nP5\n")
    ids = files.ordered_ids(spark, str(path))
    assert [r.id for r in ids.orderBy("at").collect()] == ["P9", "P2", "P5"]
    files.write_tsv(ids, str(tmp_path / "out"), [F.col("at")], ("at",))
    written = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert written.read_text() == "id\nP9\nP2\nP5\n"


def test_statement_is_cancelled(spark):
    assert [tuple(r) for r in statements.small_result(statements.query(spark, "SELECT :a + 1 AS b", a=2), 60)] == [(3,)]
    with pytest.raises(ValueError):
        statements.small_result(spark.range(5), 60, most=4)
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        statements.small_result(spark.range(1 << 42, numPartitions=8).select(F.sum(F.sqrt(F.col("id").cast("double")))), 2)
    assert time.monotonic() - began < 60
    assert statements.small_result(spark.range(2), 60)


def test_best_level(spark):
    rows = spark.createDataFrame([([1.0, 4.25, 16.0], 4), ([1.0, 4.25, 16.0], 5), ([1.0, 4.0], 64), ([2.0], 1)], "d array<double>, t int").coalesce(1)
    assert [r.l for r in rows.select(geometry.best_level(F.col("d"), F.col("t")).alias("l")).collect()] == [0, 1, 1, 0]
