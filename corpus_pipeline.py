"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dedup, packing, quality_classifier, secret_scan
from tessera.llm.common import cut, discard, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and long texts are scored like others, ties and repeated rows alike; rows with null ids are scored too. Without labels of both kinds all rows
    have one score. All columns pass through under any name; an empty table gives an empty one.
    """
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates stays: texts that share `percent` of their shingles of `words` words.

    The smallest id stays, and one of its repeated rows. Null and empty texts and null ids are linked with nothing and stay; long texts
    count with all their shingles. All columns pass through under any name; an empty table gives an empty one.
    """
    return near_dedup.deduplicated(docs, words=words, percent=percent)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes.

    Null and empty texts, null ids and repeated rows stay as they are; long texts are scanned whole, and of overlapping spans the first is
    replaced and the rest of the others cut. Columns but text and n_chars pass through; an empty table gives an empty one.
    """
    return secret_scan.redacted_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for.

    A null source is a source of its own (""), null and empty texts weigh one word, long texts all their words. Rows of equal id and
    source are taken together, so ties and repeated rows share one fate. Columns pass through; an empty table gives an empty one.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    Null and empty texts are one piece of one id; long texts are cut into pieces. Repeated rows and null ids are packed each; ties of
    length go by id and piece. Other columns are not read; an empty table gives an empty one.
    """
    return packing.best_fit_packing(docs)


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("secret scan", secrets), ("mixing", mixture), ("packing", packed)]
#: The classifier, the sketches and the tokenizer have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage writes for itself, and its input, go once its rows are written, so the shared folder holds two
    stages' rows and one stage's steps at most, and the last table in the end."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as own:
            docs = cut(stage(spark, before, sf_dir), "stage-" + name.replace(" ", "-"))
            own.pop()
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return docs
