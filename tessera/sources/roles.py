"""The input tables by role, derived from star-schema tables. Nulls and malformed values are put in by rule, so that each rule has work."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X


def _none_if(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


class Roles:
    """Lazy role tables over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def rules() -> dict[str, Column]:
        """The columns of a slide over a line of an order and its part."""
        key, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        text = lambda c: c.cast("string")
        kind = F.split("p_type", " ")[0]
        patient = F.concat(F.lit("P-"), F.lpad(text(F.col("o_custkey")), 7, "0"))
        day = F.to_date("l_shipdate").cast("string")
        return {
            "image_id": text(F.col("l_orderkey") * 10 + n),
            "patient_id": patient, "sample_id": F.concat(patient, F.lit("-T"), text(F.col("o_orderkey"))),
            "mrn": _none_if(F.col("o_custkey") % 31 == 0, text(F.col("o_custkey"))),
            "stain_group": F.when(kind.isin("PROMO", "MEDIUM"), "IHC").when(kind == "STANDARD", "H&E (Initial)").when(kind == "ECONOMY", "H&E (Other)").when(kind == "LARGE", "Special"),
            "stain_name": F.when(kind == "SMALL", F.when(F.col("p_size") % 3 == 0, "H&E").otherwise("HE")).when((kind == "MEDIUM") & (F.col("p_size") % 5 == 0), "Immuno Recut L1").otherwise(F.col("p_brand")),
            "block_id": F.when(key % 11 == 0, None).when(key % 13 == 0, F.concat(F.lit("LEGACY-"), text(key))).otherwise(F.concat(F.lit("S"), text(supp), F.lit("/"), text(key % 9 + 1), F.lit("-A"), text(n))),
            "block_label": _none_if(key % 19 == 0, F.concat(F.lit("A"), text(n))),
            "part_type": F.col("p_type"), "part_description": F.col("p_name"),
            "magnification": F.when(F.col("p_size") > 25, "40x").otherwise("20x"), "file_size_bytes": supp * 1000 + key,
            "day": _none_if(supp % 7 == 0, day),
            "accession_number": F.concat(F.lit("ACC-"), text(supp), F.lit("-"), text(key % 50)),
        }

    @cached_property
    def _slides(self) -> DataFrame:
        line, order, part = self.table("lineitem"), self.table("orders"), self.table("part")
        supp, text = F.col("l_suppkey"), lambda c: c.cast("string")
        joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(
            "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", *[c.alias(name) for name, c in self.rules().items()], F.col("o_orderpriority").alias("cancer_type"),
            F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus").alias("cancer_type_detailed"), F.substring("o_orderpriority", 1, 1).alias("oncotree_code"), F.element_at(F.split("p_type", " "), -1).alias("primary_site"),
            F.when(F.col("l_linenumber") % 2 == 0, "Metastasis").otherwise("Primary").alias("sample_type"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).alias("metastatic_site"),
            _none_if(supp % 5 == 0, text(F.col("l_partkey") % 100)).alias("tumor_purity"), F.concat_ws(";", F.slice(F.split("p_name", " "), 1, (supp % 3).cast("int"))).alias("oncogenic_mutations"), (supp % 3).cast("int").alias("num_oncogenic_mutations"),
            F.round(F.col("l_quantity").cast("double") / 4, 2).alias("cvr_tmb_score"), F.when(F.col("l_tax").cast("double") > 0.06, "Instable").otherwise("Stable").alias("msi_type"),
        )

    @staticmethod
    def is_slide() -> Column:
        """Lines without their order or part are in the inventory alone."""
        return F.col("o_orderkey").isNotNull() & F.col("p_partkey").isNotNull()

    @staticmethod
    def is_block() -> Column:
        return (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "N")

    @staticmethod
    def is_part() -> Column:
        return (F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 3 != 0)

    @staticmethod
    def part_rules(sample: Column, description: Column, label: Column, day: Column) -> dict[str, Column]:
        """What the part-matched source says in its own way."""
        key = F.col("l_partkey")
        return {
            "sample_id": _none_if(key % 17 == 0, sample), "part_number": _none_if(key % 11 == 0, (key % 9 + 1).cast("string")),
            "block_number": _none_if(key % 13 == 0, F.col("l_linenumber").cast("string")), "block_label": label, "spec_title": description,
            "procedure_text": F.when(F.col("l_suppkey") % 23 == 0, "n/a").otherwise(day),
            "slide_url": _none_if(key % 5 != 0, F.concat(F.lit("s3://secondary/url-"), key.cast("string"))),
        }

    @staticmethod
    def path() -> Column:
        store = F.when(F.col("l_returnflag") == "R", "s3://primary/").when(F.col("l_returnflag") == "A", "s3://secondary/").otherwise("file:///archive/")
        return F.concat(store, F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".svs"))

    #: So many lines are laid in a task at most, on average. They move as some 20 bytes, but rows with all their texts are sorted where they lie.
    LINES_A_TASK = 200_000

    @cached_property
    def parts(self) -> int:
        """How many partitions lines are laid in; 0 where Spark's own number will do. Parquet counts rows from its footers.

        With a fixed number the lines of a task grow with the table: at a million, the sorts of their texts spill twice what all shuffles move."""
        n = -(-self.table("lineitem").count() // self.LINES_A_TASK)
        return n if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else 0

    def laid(self, df: DataFrame, *keys: str) -> DataFrame:
        """df by keys, in as many partitions as the lines."""
        return df.repartition(self.parts, *keys) if self.parts else df.repartition(*keys)

    @cached_property
    def lines(self) -> DataFrame:
        """All lines of an order with what their slides are made of, numbers rather than texts, so that a shuffle moves little; `rules` makes the
        texts where the rows lie. Rows of one image, and all lines of an order whose numbers have one digit, have one `home` and lie together.

        Small orders are not broadcast: the join lays the lines by home, and without that all later steps would shuffle them with their texts."""
        order, image = F.col("l_orderkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
        source = self.table("lineitem").where(order.isNotNull())
        line = source.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("l_shipdate"))
        part = self.table("part").select("p_partkey", "p_type", "p_name", "p_brand", "p_size")
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.greatest(F.when(self._in_a(), self._reported_a().try_cast("date")), F.when(self._in_b(), X.text_date(self._reported_b()))).alias("sequenced"))
        rows = self.laid(line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left"), "l_orderkey")
        rows = rows.join(self.laid(orders, "o_orderkey").hint("merge"), order == F.col("o_orderkey"), "left").withColumn("image", image)
        if source.where(~F.col("l_linenumber").between(0, 9)).isEmpty():
            return rows.withColumn("home", order)
        home = F.coalesce(F.floor(F.col("image") / 10).cast("long"), order)
        return self.laid(rows.withColumn("home", home), "home")

    @cached_property
    def inventory(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("image_id"), self.path().alias("path"))

    #: What the block-matched source says of the sample of a slide.
    CLINICAL = ["cancer_type", "cancer_type_detailed", "oncotree_code", "primary_site", "sample_type", "metastatic_site", "tumor_purity", "oncogenic_mutations", "num_oncogenic_mutations", "cvr_tmb_score", "msi_type"]
    _SHARED = ["image_id", "part_type", "part_description", "stain_name", "stain_group", "magnification", "file_size_bytes"]

    @cached_property
    def block_matched(self) -> DataFrame:
        own = self._slides.where(self.is_block())
        return own.select("patient_id", "sample_id", "mrn", "block_id", "block_label", F.col("day").alias("dop"), *self.CLINICAL, *self._SHARED)

    @cached_property
    def part_matched(self) -> DataFrame:
        own = self.part_rules(F.col("sample_id"), F.col("part_description"), F.col("block_label"), F.col("day"))
        return self._slides.where(self.is_part()).select("patient_id", "mrn", *[c.alias(name) for name, c in own.items()], *self._SHARED)

    @cached_property
    def cleaned(self) -> DataFrame:
        return self._slides.select("mrn", "accession_number", "block_id", "block_label", *self._SHARED)

    @cached_property
    def surgical(self) -> DataFrame:
        return self._slides.select("accession_number", F.col("day").alias("procedure_date"))

    @cached_property
    def _orders(self) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        return self.table("orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.concat(F.lit("P-"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"), F.lit("-T"), key).alias("sample_id"))

    @staticmethod
    def _in_a() -> Column:
        return F.col("o_orderstatus").isin("F", "P")

    @staticmethod
    def _in_b() -> Column:
        return F.col("o_orderstatus").isin("O", "P")

    @staticmethod
    def _reported_a() -> Column:
        return F.when(F.col("o_orderkey") % 97 == 0, "unknown").otherwise(F.to_date("o_orderdate").cast("string"))

    @staticmethod
    def _reported_b() -> Column:
        text = F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "EEE, dd MMM yyyy")
        return F.when(F.col("o_orderkey") % 89 == 0, F.concat(F.substring(text, 1, 8), F.lit("Foo"), F.substring(text, 12, 5))).otherwise(text)

    @cached_property
    def sequencing_a(self) -> DataFrame:
        return self._orders.where(self._in_a()).select("sample_id", self._reported_a().alias("reported"))

    @cached_property
    def sequencing_b(self) -> DataFrame:
        return self._orders.where(self._in_b()).select("sample_id", self._reported_b().alias("reported"))

    @cached_property
    def registry(self) -> DataFrame:
        """Earlier thumbnail results: a third of the images, some failed, some with another path, some twice."""
        return self.inventory.withColumn("n", F.col("image_id").cast("long")).where(F.col("n") % 3 == 0).select(
            "image_id", F.when(F.col("n") % 5 == 0, "s3://moved/old.svs").otherwise(F.col("path")).alias("source_path"),
            F.when(F.col("n") % 4 == 0, "failed").otherwise("success").alias("status"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") % 1000).alias("rendered_at"),
        ).distinct()
