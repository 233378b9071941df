"""Column rules, operators, files, limiter: small made-up rows."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.functions import exprs as X
from tessera.functions import service as S
from tessera.operators import relational
from tessera.plans import geometry, nightly, operations, requests, serving
from tessera.plans.timeline import timeline
from tessera.sources import documents, files, statements
from tessera.streaming.limiter import admit, rate_limit_admissions, rate_limit_stream


def values(df, column):
    return [r[column] for r in df.collect()]


def test_stains(spark):
    df = spark.createDataFrame([("IHC", "Immuno Recut L1"), ("IHC", "Unstained 3"), ("H&E (Other)", "x"), (None, " he "), (None, None), ("ihc", "H&E")], "g string, n string").coalesce(1)
    g, n = F.col("g"), F.col("n")
    assert values(df.select(X.exclusive_subtype(g, n).alias("s")), "s") == ["IHC", "IHC", "H&E", "H&E", None, "IHC"]
    assert values(df.select(X.ihc_diagnostic(g, n).alias("s")), "s") == [False] * 6
    assert values(df.select(X.hne_by_name_or_group(g, n).alias("s")), "s") == [False, False, True, True, False, True]


def test_keys_and_dates(spark):
    df = spark.createDataFrame([("S1/4-A2", None), ("X/12-7b", "lbl"), ("LEGACY", "3x"), (None, None)], "b string, l string").coalesce(1)
    got = [tuple(r["f"]) for r in df.select(X.block_fields(F.col("b"), F.col("l")).alias("f")).collect()]
    assert got == [(4, "A2", "A2"), (12, "7", "lbl"), (None, "3", "3x"), (None, "", None)]
    d = spark.createDataFrame([("Mon, 04 Mar 2019",), ("Mon, 04 Foo 2019",), ("bad",), (None,)], "t string").coalesce(1)
    assert [str(v) for v in values(d.select(X.text_date(F.col("t")).alias("d")), "d")] == ["2019-03-04", "None", "None", "None"]
    e = spark.createDataFrame([("a b~*&/",)], "t string")
    assert values(e.select(X.form_encoded(F.col("t")).alias("t")), "t") == ["a+b~%2A%26%2F"]


def test_query_kind():
    assert [serving.query_kind(t) for t in ("p-0001-t1", "P-12", "77", "x", "")] == ["sample", "patient", "slide", None, None]


def test_upsert_missing_counts_shards(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    b = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, relational.upsert(a, b, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert values(relational.missing(a, b, ["k"]), "k") == ["a"]
    assert sorted(map(tuple, relational.appended_counts(a, b.select("k", F.col("v").alias("n")), "k", ["n"]).collect())) == [("a", 1, 0), ("b", 2, 3)]
    with pytest.raises(ValueError):
        relational.appended_counts(a, b, "k", ["v"])
    ids = spark.createDataFrame([(f"{k:02}",) for k in range(11)], "i string")
    got = sorted(map(tuple, relational.contiguous_shards(ids, [F.col("i")], 3, 4).select("i", "shard").collect()))
    assert [s for _, s in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]


def test_timeline_groups(spark):
    schema = "patient_id string, image_id string, sample_id string, match_level string, part_number string, block_number string, block_label string, part_description string, stain_group string, stain_name string, specimen_key string, can_serve_tiles boolean, procedure_date_days int, timepoint_source string"
    row = lambda image, serve, group="IHC": ("P1", image, "P1-T1", "BLOCK", "2", "b", " A  1 ", "skin", group, "n", "k", serve, 5, "src")
    got = timeline(spark.createDataFrame([row("i1", True), row("i2", True), row("i3", False), row("i4", True, "other")], schema)).collect()
    assert sorted((r.SPECIMEN, r.IMAGE_COUNT, r.NON_SERVABLE_IMAGE_COUNT, r.LINKOUT != "") for r in got) == [("Part 2 / Block A 1", "0", "1", False), ("Part 2 / Block A 1", "2", "0", True)]


def test_geometry(spark):
    slides = spark.createDataFrame([(1, 1024, 512, 3, 0, 0, 0), (1, 1024, 512, 3, 2, 3, 1), (1, 1024, 512, 3, 2, 4, 0), (1, 1024, 512, 3, 9, 0, 0)], "slide_id long, width long, height long, levels int, z int, x int, y int").coalesce(1)
    got = geometry.tile_geometry(slides).collect()
    assert [(r.status, r.max_zoom, r.out_width, r.out_height) for r in got] == [("ok", 2, 256, 128), ("ok", 2, 256, 256), ("out_of_bounds", 2, None, None), ("out_of_range", 2, None, None)]
    assert [r.status for r in geometry.decode_plan(slides, 40_000).collect()] == ["ok", "too_large", "out_of_bounds", "out_of_range"]
    none = geometry.thumbnail_plan(slides.limit(1), 256, 10)
    assert none.first().status == "no_safe_level"


def test_prune_keeps_locked(spark):
    rows = [(0, "a", 1, 50, True), (0, "b", 2, 30, False), (0, "c", 3, 40, False)]
    got = operations.cache_prune_plan(spark.createDataFrame(rows, "node int, path string, mtime long, size long, locked boolean"), 0.9, 0.8)
    assert values(got, "path") == ["b", "c"]


def test_limiter_batch_and_stream(spark, tmp_path):
    assert admit([0, 1, 59.9, 60, 61], [], 2, 60) == [True, True, False, True, True]
    assert admit([0, 0, 0], [], 0, 60) == [True] * 3
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in rate_limit_admissions(events, 1, 5e6).collect()}
    stream = rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 1, 5e6)
    stream.writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("admitted").collect()} == batch
    assert len({a for _, _, a in batch}) == 2


def test_files(spark, tmp_path):
    clinical = tmp_path / "data.txt"
    clinical.write_text("#a\tb\tc\n#d\te\tf\n#S\tS\tN\n#1\t1\t1\nPATIENT_ID\tX\tY\nP1\t1\t2\nP1\t3\nP2\t\t5\n")
    assert sorted(values(files.clinical_ids(spark, str(clinical)), "PATIENT_ID")) == ["P1", "P2"]
    assert files.without_attributes(spark, str(clinical), str(tmp_path / "out"), ["X", "Z"]) == ["X"]
    assert sorted(values(spark.read.text(str(tmp_path / "out")), "value")) == sorted(["#a\tc", "#d\tf", "#S\tN", "#1\t1", "PATIENT_ID\tY", "P1\t2", "P1\t", "P2\t5"])
    (tmp_path / "r.json").write_text('{"image_id":"1","status":"success"}\n{"image_id":"2","sta\n{"status":"failed"}\n\n')
    assert values(files.read_results(spark, str(tmp_path / "r.json")), "image_id") == ["1"]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "master_size": 64, "slides": {"a": {"uri": "u", "width": 0}, "b": {"width": 3}}}))
    assert [(r.image_id, r.width, r.height, r.content_type) for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", 1, 64, "image/jpeg")]
    files.publish(spark.range(3), str(tmp_path / "t"))
    files.publish(spark.range(5), str(tmp_path / "t"))
    assert files.read_published(spark, str(tmp_path / "t")).count() == 5
    files.write_candidates(spark.createDataFrame([("2", "b"), ("1", "a"), ("3", "c")], "image_id string, path string"), str(tmp_path / "c"), 2)
    assert sorted(map(tuple, files.read_candidates(spark, str(tmp_path / "c")).collect())) == [("1", "a"), ("2", "b")]
    files.publish_release({"part": spark.range(2)}, str(tmp_path / "rel"), "r1")
    files.publish_release({"part": spark.range(4)}, str(tmp_path / "rel"), "r2")
    assert files.read_release(spark, str(tmp_path / "rel"), "part").count() == 4


def test_more_files(spark, tmp_path):
    study = tmp_path / "study_x"
    study.mkdir()
    assert files.study_identifier(spark, str(study)) == "study_x"
    (study / "meta_study.txt").write_text("name: n\ncancer_study_identifier: own \n")
    assert files.study_identifier(spark, str(study)) == "own"
    (study / "data.txt").write_text("#a\tb\n\n#c\td\n#S\tS\n#1\t1\nSAMPLE_ID\tX\nS1\t1\n  \nS2\nS1\t3\n")
    assert sorted(values(files.positional_ids(spark, str(study / "data.txt")), "id")) == ["S1", "S1", "S2"]
    index = {"version": 2, "studies": {"s1": {"patients": ["P1", "P1"], "samples": None, "slides": {"7": {"patient_id": "P1", "source_path": None}}}, "s2": {"slides": {}}}}
    path = tmp_path / "index.json"
    path.write_text(json.dumps(index))
    rows = files.read_index(spark, str(path))
    assert sorted(tuple(r) for r in rows.fillna("").collect()) == [("s1", "patient", "P1", "", ""), ("s1", "slide", "7", "P1", "")]
    documents.publish_index_document(rows, str(tmp_path / "again"))
    again = documents.read_index_document(spark, documents.current_document(spark, str(tmp_path / "again")))
    assert again.exceptAll(rows).isEmpty() and rows.exceptAll(again).isEmpty()
    first = files.index_revision(spark, str(path))
    for wrong in ({**index, "version": 1}, {"version": 2}, {"version": 2, "studies": {"s": {"slides": None}}}, {"version": 2, "studies": {"s": {"slides": {"7": {"patient_id": ""}}}}}):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            files.read_index(spark, str(path))
    assert len(first) == 16 and files.index_revision(spark, str(path)) != first


def test_statements(spark):
    spark.createDataFrame([("1", "P2", "b"), ("1", "P1", "a"), ("2", "P1", "c'")], "image_id string, patient_id string, stain_name string").selectExpr("*", "'IHC' stain_group", "'40x' magnification", "5 file_size_bytes").createOrReplaceTempView("slide_rows")
    assert [r.stain_name for r in statements.slide_row(spark, "slide_rows", "1").collect()] == ["a"]
    assert [r.stain_name for r in statements.slide_row(spark, "slide_rows", "1", "P2").collect()] == ["b"]
    assert statements.slide_row(spark, "slide_rows", "1' OR '1' = '1").isEmpty()


def test_service_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first()["c"]
    text = lambda t: F.lit(t).cast("string")
    assert [get(S.flag(text(t), True)) for t in (" TRUE ", "0", None)] == [True, False, True]
    with pytest.raises(Exception, match="invalid boolean"):
        get(S.flag(text("yes")))
    assert [get(S.optional_int(text(t))) for t in ("12", " 7 ", "", "1.5", None)] == [12, 7, None, None, None]
    assert [get(S.side(F.lit(n))) for n in (-3, 5, 9999)] == [1, 5, 2048]
    assert [get(S.placeholder_ttl(F.lit(r), F.lit(n), F.lit(m))) for r, n, m in (("missing", 60, 0), ("missing", 60, 45), ("missing", 0, 45), ("broken", 60, 45))] == [60, 45, 1, None]
    roots = {"s3://b/t/manifest.json": "s3://b/t/masters", "s3://b/t/": "s3://b/t/masters", "s3://b/t/m-manifest.json": "s3://b/t/masters", " ": "", "manifest.json": "./masters"}
    assert [get(S.masters_root(text(u))) for u in roots] == list(roots.values())
    assert [(get(S.bucket(text(u))), get(S.object_key(text(u)))) for u in ("s3://b/k/x.svs", "s3://b/", "file:///b/k", None)] == [("b", "k/x.svs")] + [(None, None)] * 3
    assert get(S.cache_key("tile", S.scoped(text(None), text("7")), F.lit(1), F.lit(2), F.lit(3))) == "tile:7:1:2:3"
    properties = [{"tiffslide.mpp-x": "0.5", "openslide.mpp-x": "9", "openslide.vendor": "v"}, {"tiffslide.mpp-x": "wide", "tiffslide.vendor": "v"}]
    got = spark.createDataFrame([(p,) for p in properties], "p map<string,string>").coalesce(1).select(S.slide_properties(F.col("p")).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [(0.5, 0.0, "v", None), (0.0, 0.0, "", None)]


def test_claims(spark):
    good = ("HS256", "JWT", "viewer", "wsi:read", "u", "s", 1, 1500, 900)
    bad = {"algorithm": (0, "none"), "audience": (2, "x"), "subject": (4, None), "study": (5, " "), "version": (6, 2), "expired": (7, 1000), "issued": (8, 1061), "lifetime": (8, 100)}
    rows = [good] + [good[:k] + (v,) + good[k + 1 :] for k, v in bad.values()]
    df = spark.createDataFrame(rows, "alg string, typ string, aud string, scope string, sub string, study_id string, wsi_auth_version long, exp long, iat long").coalesce(1)
    assert values(df.select(S.claim_refusal(F.lit(1000), "viewer", 1000).alias("r")), "r") == [None, *bad]


def test_suggestions_and_slices(spark):
    found = spark.createDataFrame([("P1", None, 3), ("P2", "x", 0)], "patient_id string, cancer_type string, slide_count int").coalesce(1)
    assert values(serving.suggestions(found, "patient"), "sublabel") == ["3 slides", "x · 0 slides"]
    slides = spark.createDataFrame([("1", "P1", None), ("2", None, "H&E")], "image_id string, patient_id string, stain_name string").coalesce(1)
    assert values(serving.suggestions(slides, "slide"), "sublabel") == ["P1", "H&E"]
    ids = spark.createDataFrame([(f"{k:02}",) for k in range(7)], "i string")
    assert [s for _, s in sorted(map(tuple, relational.round_robin_shards(ids, [F.col("i")], 3).collect()))] == [0, 1, 2, 0, 1, 2, 0]
    assert tuple(requests.publish_counts(spark.createDataFrame([("success",), ("failed",), (None,)], "status string")).first()) == (1, 2, 3)


def test_nightly(spark, tmp_path):
    counts = [[t.count() for t in nightly.refresh(spark, "/root/testdata/sf0.001", str(tmp_path))] for _ in range(2)]  # each run replaces the tables
    assert counts[0] == counts[1] and min(counts[0]) > 0
    later = nightly.published(spark, "/root/testdata/sf0.001", str(tmp_path))
    plan = timeline(later.associations)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "lineitem" not in plan and later.associations.count() == counts[0][0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
