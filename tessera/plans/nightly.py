"""The nightly refresh: the association table, then the summary over it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.canonical import Canonical
from tessera.sources.files import publish, read_published
from tessera.sources.roles import Roles


def refresh(spark: SparkSession, folder: str, out: str, at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Publishes out/associations and, from the published rows, out/summary. A failure leaves the tables of the night before."""
    c = Canonical(Roles(spark, folder), at=at)
    publish(c.associations, f"{out}/associations")
    c.release()
    c.use(read_published(spark, f"{out}/associations"))
    publish(c.summary, f"{out}/summary")
    return c.associations, read_published(spark, f"{out}/summary")


def published(spark: SparkSession, folder: str, out: str, at: datetime | None = None) -> Canonical:
    """The steps over the table that the last refresh published: what reads the associations scans that table alone and derives nothing again,
    so the jobs of a night share one derivation. A refresh that ends meanwhile does not change rows that were asked for before."""
    c = Canonical(Roles(spark, folder), at=at)
    c.use(read_published(spark, f"{out}/associations"))
    return c
