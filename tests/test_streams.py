"""Streams that keep tables up to date, and the state that they hold."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.operators.relational import upsert
from tessera.plans import stored
from tessera.plans.canonical import Canonical
from tessera.sources import files
from tessera.streaming.limiter import rate_limit_admissions, rate_limit_stream
from tessera.streaming.registry import COLUMNS, Registry, registry_stream, retried


def result(image, status, at, path="p"):
    return {"image_id": image, "source_path": path, "status": status, "rendered_at": f"2025-01-0{at} 00:00:00"}


def key(rows):
    return sorted((r["image_id"], r["source_path"], r["status"], str(r["rendered_at"])) for r in rows)


WAVES = [
    [result(f"i{k}", "success", 1) for k in range(40)] + [result("i1", "failed", 3, "q"), result("", "success", 1), {"image_id": None, "status": "success"}],
    [result(f"i{k}", "failed", 2) for k in range(5, 9)] + [result("new", "success", 2), result("new", "failed", 2)],
    [result("i5", "success", 4), result("i5", "success", 4), result("x/ß", "success", 4)],
]


def run(registry, source, folder):
    query = registry_stream(registry, source, f"{folder}/checkpoint", 1)
    query.awaitTermination()
    return query


def test_stream_equals_one_upsert(spark, tmp_path):
    source, registry = tmp_path / "results", Registry(spark, str(tmp_path / "registry"), 8)
    source.mkdir()
    base = spark.createDataFrame([("i0", "old", "success", "2024-01-01"), ("gone", "old", "failed", "2024-01-01")], "image_id string, source_path string, status string, rendered_at string").withColumn("rendered_at", F.col("rendered_at").cast("timestamp"))
    assert registry.apply(base, 0) == {"record_count": 2, "success_count": 1, "failure_count": 1}
    before = registry.state()["buckets"]
    for n, wave in enumerate(WAVES):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, wave)) + '\n{"image_id": "trunc\n')
        run(registry, str(source), tmp_path)
    expected = {"i0": ("p", "success", "2025-01-01 00:00:00"), "gone": ("old", "failed", "2024-01-01 00:00:00")}
    for wave in WAVES:
        last = {}
        for r in wave:
            if r["image_id"] and ((r["rendered_at"], r["status"] == "success") > last.get(r["image_id"], ("", False))[:2]):
                last[r["image_id"]] = (r["rendered_at"], r["status"] == "success", r["source_path"], r["status"])
        expected |= {i: (p, s, t) for i, (t, _, p, s) in last.items()}
    assert key(registry.rows().collect()) == sorted((i, *v) for i, v in expected.items())
    after = registry.state()
    assert len(after["buckets"]) == 8 and after["batches"]["batch"] == 0
    # A batch that is applied twice changes nothing, under any later rows.
    assert registry.apply(base, 0)["record_count"] == 0 and registry.state() == after
    again = spark.read.schema(files.RESULT).json(str(source / "0.json"))
    assert registry.apply(again, 0, f"{tmp_path}/checkpoint")["record_count"] == 0 and registry.state() == after
    # A batch writes only the buckets of its images.
    registry.apply(spark.createDataFrame([("i0",)], "image_id string"), 1)
    moved = {b for b, v in registry.state()["buckets"].items() if v != after["buckets"][b]}
    assert len(moved) == 1 and set(before) <= set(after["buckets"])
    assert registry.rows().columns == COLUMNS


def test_crash_before_the_switch(spark, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path / "r"), 4)
    first = spark.createDataFrame([("a", "success"), ("b", "failed")], "image_id string, status string")
    registry.apply(first, 0)
    state = registry.state()
    monkeypatch.setattr(Registry, "_switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        retried(lambda: registry.apply(spark.createDataFrame([("a", "failed")], "image_id string, status string"), 1), delay=0)
    assert registry.state() == state and sorted((r.image_id, r.status) for r in registry.rows().collect()) == [("a", "success"), ("b", "failed")]
    monkeypatch.undo()
    registry.apply(spark.createDataFrame([("a", "failed")], "image_id string, status string"), 1)
    assert sorted((r.image_id, r.status) for r in registry.rows().collect()) == [("a", "failed"), ("b", "failed")]


def test_retries():
    seen = []

    def step():
        seen.append(1)
        if len(seen) < 3:
            raise OSError
        return {"n": len(seen)}

    assert retried(step, delay=0) == {"n": 3}
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, delay=0)


def test_stream_fails_after_three_attempts_and_goes_on(spark, tmp_path, monkeypatch):
    source, registry = tmp_path / "results", Registry(spark, str(tmp_path / "registry"), 4)
    source.mkdir()
    (source / "0.json").write_text(json.dumps(result("a", "success", 1)))
    tried = []
    monkeypatch.setattr("tessera.streaming.registry.time.sleep", lambda _: None)
    monkeypatch.setattr(Registry, "apply", lambda *_: tried.append(1) or (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(Exception, match="no"):
        run(registry, str(source), tmp_path)
    assert len(tried) == 3
    monkeypatch.undo()
    run(registry, str(source), tmp_path)
    assert [r.image_id for r in registry.rows().collect()] == ["a"]


def test_limiter_state_expires(spark, tmp_path):
    """Subjects that stay away leave no state; admissions are those of the batch query."""
    rows = [(k, k % 20, k * 0.5) for k in range(200)] + [(1000, 777, 100_000.0), (1001, 777, 100_001.0), (1002, 777, 100_500.0), (1003, 778, 200_000.0), (1004, 778, 200_001.0), (1005, 778, 200_002.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s double").select("event_id", "user_id", F.timestamp_millis((F.col("s") * 1000).cast("long") + 10**9).alias("ts"))
    expected = {tuple(r) for r in rate_limit_admissions(events, 2, 60.0).collect()}
    source = tmp_path / "in"
    source.mkdir()
    stream = rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(source)), 2, 60.0, "10 seconds")
    held = []
    for bound in ((0, 100), (100, 200), (1000, 1003), (1003, 1006)):
        events.where(F.col("event_id").between(bound[0], bound[1] - 1)).coalesce(1).write.mode("append").parquet(str(source))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected
    assert max(held[:2]) >= 20 and held[-1] <= 6, held


def test_servable_patients_only(spark):
    """A patient whose slides all lie elsewhere is neither listed nor counted."""
    from tessera.plans import serving
    from tessera.sources.roles import Roles

    c = Canonical(Roles(spark, "/root/testdata/sf0.001"), at=stored.CLOCK)
    c.__dict__["associations"] = spark.createDataFrame(
        [("P-0000001", "s3://a/1", 1), ("P-0000001", "file:///b", 2), ("P-0000002", "file:///c", 3), ("P-0000002", None, 3), ("P-9999999", "s3://a/2", 9)], "patient_id string, slide_path string, day int"
    ).select("patient_id", "slide_path", F.lit("v").alias("association_version"), F.timestamp_seconds(F.col("day") * 86400).alias("updated_at"))
    assert [r.patient_id for r in serving.resource_patients(c).collect()] == ["P-0000001"]
    got = serving.manifest_stats(c).first()
    assert (got.n_rows, got.n_patients, got.updated_at.day) == (1, 1, 2)
    c.__dict__["associations"] = c.associations.where("false")
    got = serving.manifest_stats(c).first()
    assert (got.n_rows, got.updated_at) == (0, stored.CLOCK.replace(tzinfo=None)) and got.association_version is None


def test_staged_steps_are_released(spark):
    from tessera.sources.roles import Roles

    c = Canonical(Roles(spark, "/root/testdata/sf0.001"))
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    spark.catalog.clearCache()
    before = held()
    c.paths.count()
    assert held() == before + 1
    c.release()
    assert held() == before
    assert upsert(spark.range(3), spark.range(1, 2), ["id"]).count() == 3
