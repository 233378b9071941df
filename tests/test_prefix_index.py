"""The stored prefix index against Python's own folding and order."""

import re

import pytest
from pyspark.sql import functions as F
from tessera.sources import files
from tessera.sources.prefix_index import prefix_requests, prefix_rows, prefix_suggestions, successor, write_prefix_index

IDS = ["Straße1", "STRASSE2", "strasse", "İd", "i̇d2", "ID", "ıd", "ΑΣ", "ας", "ab", "AB", "Ab", "a", "", "￿", "\U0010ffffz", "\U0010ffff", "é", "É2", "%_x", "a\x00b", "zz"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prefix"))
    rows = [(s, t, x) for s in ("s1", "s2") for t in ("patient", "slide") for x in IDS] + [("s1", "patient", None), ("s1", "patient", "ab")]
    rows += [("s3", "slide", f"N{k:05d}") for k in range(3000)]
    write_prefix_index(spark.createDataFrame(rows, "study_id string, resource_type string, resource_id string"), path, 12)
    return path


def plain(ids, text, most=8):
    return [x for _, x in sorted((x.casefold(), x) for x in set(ids) if x.casefold().startswith(text.casefold()))[:most]]


def test_folding_and_order(spark, index):
    for text in ["strass", "STRASS", "straß", "i", "İ", "I", "ı", "as", "ΑΣ", "ασ", "A", "", "￿", "\U0010ffff", "\U0010ffffZ", "É", "%", "a\x00", "zzz"]:
        assert [r[0] for r in prefix_suggestions(spark, index, "s1", "patient", text).collect()] == plain(IDS, text), text
    assert prefix_rows(spark, index, "none", "patient", "a").isEmpty()


def test_requests_at_once(spark, index):
    texts = ["strass", "A", "", "É", "ΑΣ", "\U0010ffff", "nothing"]
    asked = spark.createDataFrame([(s, "patient", t) for s in ("s1", "s2", "s9") for t in texts] + [("s3", "slide", "n0001"), ("s1", "patient", None)], "study_id string, resource_type string, text string")
    got = {}
    for r in prefix_requests(spark, index, asked).collect():
        got.setdefault((r.study_id, r.text), []).append((r["rank"], r.resource_id))
    for s in ("s1", "s2"):
        for t in texts:
            assert [x for _, x in sorted(got.get((s, t), []))] == plain(IDS, t)
    assert [x for _, x in sorted(got["s3", "n0001"])] == [f"N0001{k}" for k in range(8)] and not any(s == "s9" for s, _ in got)


def test_only_ranges_that_can_hold_a_prefix_are_read(spark, index):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = prefix_rows(spark, index, "s3", "slide", "n0012")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(folded,n0012)" in plan and "LessThan(folded,n0013)" in plan and re.search(r"PartitionFilters: \[[^\]]*part#", plan)
    assert rows.count() == 10
    used = {r[0] for r in rows.select(F.col("_metadata.file_path")).collect()}
    total = len(spark.read.parquet(f"{index}/{files.current_version(spark, index)}/ids").inputFiles())
    assert len(used) == 1 and total >= 10


def test_successor():
    assert [successor(x) for x in ("a", "az\U0010ffff", "\U0010ffff", "", "퟿")] == ["b", "a{", None, None, ""]


def test_empty_index(spark, tmp_path):
    write_prefix_index(spark.createDataFrame([], "study_id string, resource_type string, resource_id string"), str(tmp_path))
    assert prefix_suggestions(spark, str(tmp_path), "s1", "patient", "a").isEmpty()
