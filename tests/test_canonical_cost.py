"""The canonical plan over tables with odd keys, and how much it moves."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.plans import snapshot_load, stored
from tessera.plans.canonical import Canonical
from tessera.plans.registry import ORACLES, QUERIES
from tessera.sources import files
from tessera.sources.roles import Roles

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Line numbers of two digits and below zero, whose images fall to other orders; lines without order, part or key; orders twice; customers of eight digits."""
    folder = tmp_path_factory.mktemp("odd")
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    line = read("lineitem").withColumn("h", F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), F.lit(40)))
    line = line.withColumns({
        "l_linenumber": F.when(F.col("h").between(2, 5), number + 10).when(F.col("h") == 6, -number).otherwise(number).cast("int"),
        "l_orderkey": F.when(F.col("h") == 7, None).when(F.col("h") == 8, key + 1_000_000).otherwise(key), "l_partkey": F.when(F.col("h") == 9, F.col("l_partkey") + 1_000_000).otherwise(F.col("l_partkey")),
    }).drop("h")
    orders = read("orders")
    own = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 12_345_000).otherwise(F.col("o_custkey"))
    orders = orders.unionByName(orders.where("o_orderkey % 9 = 0").withColumn("o_orderdate", F.col("o_orderdate") + F.expr("interval 3 days"))).unionByName(orders.where("o_orderkey % 14 = 0").withColumn("o_custkey", F.col("o_custkey") + 1))
    for t in TABLES:
        df = {"lineitem": line, "orders": orders.withColumn("o_custkey", own)}.get(t)
        (read(t) if df is None else df).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["canonical_associations", "preferred_associations", "block_matches", "part_matches", "unmatched_associations"])
def test_odd_keys(spark, odd, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    df, rel = QUERIES[name](spark, odd), duck.sql(ORACLES[name])
    rows = lambda columns, data: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in data)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert len(got) > 500 and set(got) ^ set(want) == set() and got == want


def moved(spark) -> int:
    """The bytes that the session's stages have shuffled."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize(("name", "most"), [("canonical_associations", 250), ("index_file", 330), ("loaded_part", 400)])
def test_few_bytes_are_shuffled(spark, name, most):
    """With no side small enough to broadcast: rows travel as numbers, and what homes know as one row each; what has several readers is kept."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        QUERIES[name](spark, LARGER).write.format("noop").mode("overwrite").save()
        assert 0 < moved(spark) - before < most * 60_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("name", "most"), [("slide_bindings", 160), ("loaded_part", 190), ("loaded_block", 190)])
def test_rows_move_once_after_the_associations(spark, name, most):
    test_few_bytes_are_shuffled(spark, name, most)


@pytest.mark.parametrize(("name", "most"), [("canonical_associations", 130), ("timeline_events", 200), ("release_slide", 180)])
def test_few_bytes_are_shuffled_where_orders_are_small(spark, name, most):
    """With Spark's own threshold, under which these orders would be broadcast and the lines left where no home is."""
    before = moved(spark)
    QUERIES[name](spark, LARGER).write.format("noop").mode("overwrite").save()
    assert 0 < moved(spark) - before < most * 60_000


def test_lines_are_laid_by_their_number(spark, odd, monkeypatch):
    """However few bytes are moved, no task sorts many lines with their texts; the rows stay the same."""
    monkeypatch.setattr(Roles, "LINES_A_TASK", 5_000, raising=False)
    c = Canonical(Roles(spark, LARGER), at=stored.CLOCK)
    c.associations.write.format("noop").mode("overwrite").save()
    sizes = [r["n"] for r in c._lines.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    c.release()
    assert sum(sizes) == 60_000 and max(sizes) < 10_000
    monkeypatch.setattr(Roles, "LINES_A_TASK", 500, raising=False)
    test_odd_keys(spark, odd, "canonical_associations")


@pytest.mark.parametrize(("name", "most"), [("loaded_placement", 190), ("loaded_slide", 160), ("load_violations", 180)])
def test_slides_stay_where_they_lie(spark, name, most):
    """Internal ids come to the slides' homes, and rules are told there; the slides do not go to their patients and samples."""
    test_few_bytes_are_shuffled(spark, name, most)


@pytest.mark.parametrize("table", ["placement", "slide"])
def test_ids_found_at_home_are_those_of_a_join(spark, odd, table):
    """Also where orders stand twice, some under two customers, and some patients and samples are unknown."""
    c = Canonical(Roles(spark, odd), at=stored.CLOCK)
    patients, samples = snapshot_load.identities_of(c, True)
    rows = lambda load: sorted(map(repr, getattr(load, table)().collect()))
    got, want = rows(snapshot_load.Load(snapshot_load.homed_rows_of(c), patients, samples, snapshot_load.join_at_home(c))), rows(snapshot_load.Load(snapshot_load.rows_of(c), patients, samples))
    c.release()
    assert len(got) > 500 and got == want


def test_a_stored_table_is_loaded_without_homes(spark):
    c = Canonical(Roles(spark, SF), at=stored.CLOCK)
    want = sorted(map(repr, snapshot_load.loaded(c, "placement").collect()))
    own = c.stage(c.associations)
    own.count()
    again = Canonical(Roles(spark, SF), at=stored.CLOCK)
    again.use(own)
    got = snapshot_load.loaded(again, "placement")
    assert sorted(map(repr, got.collect())) == want and "_lines" not in vars(again)
    c.release()


def kept(spark) -> int:
    """The bytes that the session's executors keep of staged steps."""
    stored = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    return sum(r.memSize() + r.diskSize() for r in stored)


def test_violations_keep_numbers_and_flags(spark):
    """Beside the lines, no text but the image id stays on the executors."""
    QUERIES["release_violations"](spark, LARGER).write.format("noop").mode("overwrite").save()
    assert 0 < kept(spark) < 90 * 60_000


def test_load_violations_keep_names_and_flags(spark):
    """No text of a slide stays on the executors."""
    QUERIES["load_violations"](spark, LARGER).write.format("noop").mode("overwrite").save()
    assert 0 < kept(spark) < 80 * 60_000


def test_rows_are_those_of_the_snapshot(spark):
    c = Canonical(Roles(spark, SF), at=stored.CLOCK)
    c.stage(c.associations)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(snapshot_load.rows_of(c)) == rows(snapshot_load.slide_rows(snapshot_load.snapshot_of(c)))
    c.release()


def test_published_tables_are_packed(spark, tmp_path):
    """What a night publishes is written with the closer of the two codecs."""
    files.publish(spark.range(100), str(tmp_path / "t"))
    assert files.read_published(spark, str(tmp_path / "t")).count() == 100
    names = [x.name for x in (tmp_path / "t").rglob("*.parquet")]
    assert names and all(x.endswith(".zstd.parquet") for x in names)
