"""Loading snapshots: what is refused, what wins, what readers see."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.plans import snapshot_load as L
from tessera.sources import documents, files

SLIDE = "image_id string, sample_id string, reference_sample_id string, part_key string, part_number string, part_type string, block_key string, block_number string, match_level string, specimen_key string, can_serve_tiles string, is_hne string, slide_path string"
LINES = f"study_id string, patient_id string, slides array<struct<{','.join(x.strip().replace(' ', ':') for x in SLIDE.split(','))}>>"
BASE = {"image_id": "7", "sample_id": "S1", "reference_sample_id": "S1", "part_key": "part:1", "part_number": "1", "part_type": "a", "block_key": "block:1", "block_number": "1", "match_level": "block", "specimen_key": "k", "can_serve_tiles": "true", "is_hne": "1", "slide_path": "s3://b/7.svs"}


@pytest.fixture(scope="module")
def known(spark):
    patients = spark.createDataFrame([("s", "P1", 1, 11), ("s", "P2", 1, 12), ("t", "P1", 2, 21)], "study_id string, patient_id string, study_internal_id long, patient_internal_id long")
    samples = spark.createDataFrame([("s", "P1", "S1", 101), ("s", "P1", "S2", 102), ("s", "P2", "S3", 103), ("t", "P1", "S1", 201)], "study_id string, patient_id string, sample_id string, sample_internal_id long")
    return patients, samples


def lines(spark, *slides, study="s", patient="P1"):
    return spark.createDataFrame([(study, patient, [{**BASE, **x} for x in slides])], LINES)


def broken(spark, known, snapshot, **more):
    return {r.rule: r.n for r in L.violations(L.slide_rows(snapshot), *known, **more).collect() if r.n}


@pytest.mark.parametrize("slides, rules", [
    ([{}], {}),
    ([{"image_id": None}], {"no_image": 1}),
    ([{"part_key": " "}, {"image_id": "8", "block_key": "a?b"}], {"bad_part_key": 1, "bad_block_key": 1}),
    ([{"match_level": "SLIDE"}], {"bad_level": 1}),
    ([{"specimen_key": ""}], {"no_specimen": 1}),
    ([{"can_serve_tiles": None}, {"image_id": "8", "is_hne": "maybe"}], {"bad_boolean": 2}),
    ([{"slide_path": "file:///x"}], {"servable_without_path": 1}),
    ([{"match_level": "UNMATCHED"}], {"unmatched_with_sample": 1}),
    ([{"sample_id": None}], {"matched_without_sample": 1}),
    ([{}, {}], {"duplicate_association": 1}),
    ([{}, {"is_hne": "0", "sample_id": "S2", "slide_path": "s3://b/8.svs"}], {"duplicate_association": 1, "conflicting_slide": 1, "conflicting_placement": 1, "association_of_other_sample": 1, "conflicting_binding": 1}),
    ([{}, {"image_id": "8", "reference_sample_id": "S2"}], {"several_references": 1}),
    ([{"sample_id": "S9"}], {"unknown_sample": 1}),
    ([{"reference_sample_id": "S3"}], {"unknown_sample": 1}),
    ([{"sample_id": None, "match_level": "UNMATCHED", "reference_sample_id": "UNMATCHED"}], {}),
])
def test_rules(spark, known, slides, rules):
    assert broken(spark, known, lines(spark, *slides)) == rules


def test_rules_where_rows_lie(spark, known):
    """The same counts where rows lie by image already, with images that are repeated, missing, in conflict or of two patients, and none moves."""
    from functools import reduce

    other = {"is_hne": "0", "sample_id": "S2", "slide_path": "s3://b/8.svs"}
    own = [lines(spark, {}, {}, {}, other, {"image_id": None}, {"image_id": None, "block_key": "?"}, {"image_id": "8"}, {"image_id": "8", "sample_id": "S9", "reference_sample_id": "S2"}), lines(spark, {}, other, {"image_id": "9", "sample_id": None}, patient="P2"), lines(spark, {}, study="t")]
    rows, kept = L.slide_rows(reduce(lambda a, b: a.unionByName(b), own)).withColumn("home", F.crc32(F.coalesce("image_id", F.lit("")))), []
    rows = rows.repartition(3, "home")
    keep = lambda df: kept.append(df) or df
    want = {r.rule: r.n for r in L.violations(rows.drop("home"), *known).collect()}
    got = {r.rule: r.n for r in L.violations(rows, *known, near=["home"], stage=keep).collect()}
    assert got == want and min(want[k] for k in ("duplicate_association", "conflicting_slide", "conflicting_placement", "association_of_other_sample", "conflicting_binding", "several_references", "no_image")) > 0
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and "slide_path" not in kept[0].columns


def test_identities(spark, known):
    patients, samples = known
    assert broken(spark, known, lines(spark, {}, patient="P9")) == {"unknown_patient": 1, "unknown_sample": 1}
    twice = samples.unionByName(samples.where("sample_internal_id = 101").selectExpr("study_id", "patient_id", "sample_id", "999L AS sample_internal_id"))
    assert broken(spark, (patients, twice), lines(spark, {})) == {"ambiguous_sample": 1}
    apart = spark.createDataFrame([("s", "P1", "7", "S2"), ("s", "P1", "9", None)], "study_id string, patient_id string, image_id string, sample_id string")
    assert broken(spark, known, lines(spark, {}), associations=apart) == {"orphan_association": 1, "association_of_other_sample_apart": 1}


def test_first_rows_win_in_input_order(spark, known):
    own = lines(spark, {"image_id": "9", "sample_id": "S2", "part_type": "late"}, {"image_id": "1", "part_type": "other", "block_number": "5"}, {"image_id": "2", "sample_id": "S2", "part_key": "part:2", "part_type": "mine"}, {"image_id": "3", "part_key": "part:2", "part_type": "not"})
    load = L.Load(L.slide_rows(own), *known)
    assert {(r.part_key, r.part_type) for r in load.part().collect()} == {("part:1", "late"), ("part:2", "mine")}
    assert {(r.part_key, r.block_number) for r in load.block().collect()} == {("part:1", "1"), ("part:2", "1")}
    assert {(r.image_id, r.sample_internal_id, r.match_level) for r in load.placement().collect()} == {("9", 102, "BLOCK"), ("1", 101, "BLOCK"), ("2", 102, "BLOCK"), ("3", 101, "BLOCK")}
    assert [(r.cancer_study_id, r.patient_internal_id, r.reference_sample_internal_id) for r in load.patient().collect()] == [(1, 11, 101)]


def test_load_is_gated_and_the_index_comes_back(spark, known, tmp_path, monkeypatch):
    folder, index = str(tmp_path / "rel"), str(tmp_path / "index")
    before = {x for x in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) if x.startswith("staged-")}
    (tmp_path / "in.json").write_text(json.dumps({"study_id": "s", "patient_id": "P1", "slides": [BASE]}) + "\n\n" + json.dumps({"study_id": "t", "patient_id": "P1", "slides": [{**BASE, "image_id": "70"}]}) + "\n")
    schema = spark.createDataFrame([], LINES).schema
    first = L.load_release(spark, files.read_snapshot(spark, str(tmp_path / "in.json"), schema), *known, folder, 1, index)
    assert files.read_release(spark, folder, "slide").count() == 2 and len(first) == 20 + 1 + 32
    with pytest.raises(ValueError, match="unknown_sample"):
        L.load_release(spark, lines(spark, {"sample_id": "S9"}), *known, folder, 2, index)
    with pytest.raises(ValueError, match="positive"):
        L.load_release(spark, lines(spark, {}), *known, folder, 0, index)
    assert files.read_release(spark, folder, "slide").count() == 2
    seen = lambda: {(r.study_id, r.resource_id) for r in documents.read_index_document(spark, documents.current_document(spark, index)).where("resource_type = 'slide'").collect()}
    assert seen() == {("s", "7"), ("t", "70")}
    second = files.read_snapshot(spark, str(tmp_path / "in.json"), schema, "s").selectExpr("study_id", "patient_id", "transform(slides, x -> named_struct(%s)) AS slides" % ", ".join(f"'{c}', " + ("'71'" if c == "image_id" else f"x.{c}") for c in BASE))
    with monkeypatch.context() as m:
        m.setattr(files, "mark_release", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            L.load_release(spark, second, *known, folder, 2, index)
    assert seen() == {("s", "7"), ("t", "70")} and files.read_release(spark, folder, "slide").count() == 2
    assert L.load_release(spark, second, *known, folder, 2, index) > first
    assert seen() == {("s", "71"), ("t", "70")} and [r.image_id for r in files.read_release(spark, folder, "slide").collect()] == ["71"]
    staged = [x for x in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) if x.startswith("staged-")]
    assert not set(staged) - before
