"""Reloading, catalog releases, study clean-up, and pyramid files."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F
from tessera.functions import service
from tessera.plans import geometry
from tessera.sources import catalog, documents, files
from tessera.sources.pyramids import planned_levels, read_pyramids
from tessera.sources.reload import Unavailable, Watched

INDEX = "study_id string, resource_type string, resource_id string, patient_id string, source_path string"


def test_reload_on_change(spark, tmp_path):
    path, reads = tmp_path / "index.json", []
    whole = {"version": 2, "studies": {"s": {"patients": ["P-1"], "samples": [], "slides": {"7": {"patient_id": "P-1"}}}}}
    path.write_text(json.dumps(whole))

    def read(s, p):
        reads.append(p)
        return files.read_index(s, p)

    watched = Watched(spark, str(path), read)
    first = watched.rows()
    assert watched.rows() is first and len(reads) == 1 and first.count() == 2
    revision = watched.revision()
    assert len(revision) == 16 and revision == files.index_revision(spark, str(path)) and len(reads) == 1
    whole["studies"]["s"]["patients"].append("P-2")
    path.write_text(json.dumps(whole))
    assert watched.rows().count() == 3 and watched.revision() != revision and len(reads) == 2
    assert first.count() == 2  # a request that began before the change ends with its rows
    good = path.read_text()
    for broken in ('{"version": 2', '{"version": 1, "studies": {}}', ""):
        path.write_text(broken)
        for _ in range(2):
            with pytest.raises(Unavailable):
                watched.rows()
            with pytest.raises(Unavailable):
                watched.revision()
    os.remove(path)
    with pytest.raises(Unavailable):
        watched.rows()
    path.write_text(good)
    assert watched.rows().count() == 3


def test_reload_of_documents(spark, tmp_path):
    index = spark.createDataFrame([("s", "patient", "P-1", None, None), ("s", "slide", "1", "P-1", "x")], INDEX)
    documents.publish_index_document(index, str(tmp_path))
    watched = Watched(spark, documents.current_document(spark, str(tmp_path)))
    assert watched.rows().exceptAll(index).isEmpty() and watched.rows() is watched.rows()


def test_catalog_releases(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS rel")
    schema = spark.createDataFrame([], "a long, b string, release_id string").schema
    for _ in range(2):
        catalog.create_release_table(spark, "rel", schema, str(tmp_path / "rel"))
    rows = lambda *x: spark.createDataFrame([(k, str(k)) for k in x], "a long, b string")
    own = lambda *r: sorted(x.a for x in catalog.release_rows(spark, "rel", *r).collect())
    assert catalog.latest_release(spark, "rel") is None and own() == []
    assert catalog.load_release(rows(1, 2).select("b", "a"), "rel", "r1") == 2
    assert catalog.load_release(rows(3), "rel", "r'2") == 1
    assert catalog.load_release(rows(4, 5), "rel", "r'2") == 2
    assert (own("r1"), own("r'2"), own()) == ([1, 2], [4, 5], [4, 5])
    plan = catalog.release_rows(spark, "rel")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(release_id" in plan and len(catalog.release_rows(spark, "rel", "r1").inputFiles()) < len(spark.table("rel").inputFiles())
    assert catalog.load_release(rows(), "rel", "r'2") == 0 and own() == [] and own("r1") == [1, 2]
    with pytest.raises(ValueError, match="differ"):
        catalog.load_release(rows(1).withColumn("c", F.lit(1)), "rel", "r1")
    spark.sql("DROP TABLE rel")
    spark.sql("DROP TABLE rel_releases")


def test_study_cleanup(spark, tmp_path):
    study = tmp_path / "study"
    study.mkdir()
    (study / "data_clinical_sample.txt").write_text("#a\tb\n#c\td\n#S\tS\n#1\t1\nPATIENT_ID\tX\nP1\t1\n")
    (study / "old.txt").write_text("x")
    (study / "kept.txt").write_text("x")
    got = files.clean_study(spark, str(study), str(tmp_path / "out"), ["X"], ["old.txt", "absent.txt"])
    assert got == {"removed_attributes": ["X"], "removed_files": ["old.txt"]}
    assert sorted(p.name for p in study.iterdir() if not p.name.startswith(".")) == ["data_clinical_sample.txt", "kept.txt"]
    for bad in ("../kept.txt", "/etc/passwd", "", "file:/x"):
        with pytest.raises(ValueError):
            files.clean_study(spark, str(study), str(tmp_path / "out2"), ["X"], ["kept.txt", bad])
    assert (study / "kept.txt").exists()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert files.clean_study(spark, str(empty), str(tmp_path / "out3"), ["X"], []) == {"removed_attributes": [], "removed_files": []}


def tiff(levels, description="", order="<", big=False, thumbnail=None):
    """A TIFF file's directories (no pixels): tiled levels and, after the first, an image that is not tiled."""
    word, count = ("Q", "Q") if big else ("I", "H")
    size = struct.calcsize(f"{order}{word}")
    images = [(w, h, True) for w, h in levels]
    if thumbnail:
        images.insert(1, (*thumbnail, False))
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42))
    out += struct.pack(f"{order}HHQ", 8, 0, 0) if big else struct.pack(f"{order}I", 0)
    link = len(out) - size
    text = description.encode() + b"\0"
    for k, (w, h, tiled) in enumerate(images):
        entries = [(256, 4, 1, struct.pack(f"{order}I", w)), (257, 3 if h < 65536 else 4, 1, struct.pack(f"{order}H" if h < 65536 else f"{order}I", h))]
        if k == 0 and description:
            entries.append((270, 2, len(text), struct.pack(f"{order}{word}", len(out)) if len(text) > size else text))
            out += text if len(text) > size else b""
        entries += [(322, 3, 1, struct.pack(f"{order}H", 256))] if tiled else []
        struct.pack_into(f"{order}{word}", out, link, len(out))
        out += struct.pack(f"{order}{count}", len(entries))
        for tag, kind, n, value in entries:
            out += struct.pack(f"{order}HH{word}", tag, kind, n) + value.ljust(size, b"\0")
        link = len(out)
        out += struct.pack(f"{order}{word}", 0)
    return bytes(out)


@pytest.fixture(scope="module")
def slides(tmp_path_factory):
    folder = tmp_path_factory.mktemp("slides")
    aperio = "Aperio Image Library v1\r\n|AppMag = 20|MPP = 0.4990|Left = 3"
    whole = {"1.svs": tiff([(40000, 30000), (10000, 7500), (2500, 1875)], aperio, thumbnail=(1024, 768)), "2.tif": tiff([(5000, 70000), (1250, 17500)], order=">", big=True), "3.tiff": tiff([(300, 200)], "x", thumbnail=(10, 10))}
    for name, data in whole.items():
        (folder / name).write_bytes(data)
    (folder / "cut.svs").write_bytes(whole["1.svs"][:150])
    (folder / "none.tif").write_bytes(b"no picture")
    (folder / "empty.tif").write_bytes(b"")
    circle = bytearray(tiff([(5, 5)]))
    circle[-4:] = struct.pack("<I", 8)
    (folder / "circle.tif").write_bytes(circle)
    (folder / "notes.txt").write_text("not an image")
    return folder


def test_pyramid_files(spark, slides):
    rows = {os.path.basename(r.path): r for r in read_pyramids(spark, str(slides), 2).collect()}
    assert set(rows) == {"1.svs", "2.tif", "3.tiff", "cut.svs", "none.tif", "empty.tif", "circle.tif"}
    assert (rows["1.svs"].level_widths, rows["1.svs"].level_heights, rows["1.svs"].error) == ([40000, 10000, 2500], [30000, 7500, 1875], None)
    assert (rows["2.tif"].width, rows["2.tif"].level_heights) == (5000, [70000, 17500]) and rows["3.tiff"].level_widths == [300]
    assert all(rows[x].error and rows[x].width is None for x in ("cut.svs", "none.tif", "empty.tif", "circle.tif"))
    assert read_pyramids(spark, str(slides), 2).rdd.getNumPartitions() == 4
    assert rows["1.svs"].properties["Left"] == "3"
    p = read_pyramids(spark, str(slides)).where(F.col("path").endswith("1.svs")).select(service.slide_properties(F.col("properties")).alias("p")).first().p
    assert tuple(p) == (0.499, 0.499, "aperio", 20)


def test_planner_takes_levels_of_files(spark, slides):
    own = planned_levels(read_pyramids(spark, str(slides)), F.regexp_extract("path", r"([^/]+)\.", 1))
    assert sorted((r.slide_id, r.levels, r.level_downsamples) for r in own.collect()) == [("1", 3, [1.0, 4.0, 16.0]), ("2", 2, [1.0, 4.0]), ("3", 1, [1.0])]
    asked = spark.createDataFrame([("1", 4, 0, 0), ("1", 8, 1000, 0), ("2", 6, 0, 1), ("2", 99, 0, 0)], "slide_id string, z int, x int, y int")
    plan = {(r.slide_id, r.z): r for r in geometry.decode_plan_by_levels(asked.join(own, "slide_id")).collect()}
    assert (plan["1", 4].downsample, plan["1", 4].level, plan["1", 4].read_width, plan["1", 4].status) == (16, 2, 256, "ok")
    assert plan["1", 8].status == "out_of_bounds" and plan["2", 99].status == "out_of_range" and (plan["2", 6].level, plan["2", 6].level_downsample) == (1, 4.0)
