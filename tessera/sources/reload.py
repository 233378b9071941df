"""Files that are read again only when they have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import documents, files


class Unavailable(ValueError):
    """A file that is missing, or does not hold what it should."""


class Watched:
    """The rows of one file as a table of its revision.

    Each use asks the file system for the time of the last change and the size. While both are the same, the table that was read stands;
    otherwise the file is read whole under the reader's rules, into a new table with a new revision. A file that is gone or broken is an
    error at every use until it is mended, and no earlier rows are served in its place."""

    def __init__(self, spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame] = documents.read_index_document) -> None:
        self.spark, self.path, self.read = spark, path, read
        self._signature: tuple[int, int] | None = None
        self._rows: DataFrame | None = None
        self._revision: str | None = None

    def signature(self) -> tuple[int, int]:
        path, fs = files.hadoop_path(self.spark, self.path)
        if not fs.exists(path):
            self._signature = None
            raise Unavailable(f"{self.path} is not there")
        status = fs.getFileStatus(path)
        return status.getModificationTime(), status.getLen()

    def _digest(self) -> str:
        """The first 16 digits of the bytes' SHA-256, by a stream in the JVM."""
        path, fs = files.hadoop_path(self.spark, self.path)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)[:16]
        finally:
            stream.close()

    def rows(self) -> DataFrame:
        seen = self.signature()
        if seen != self._signature:
            self._signature = None  # what is held no longer counts, whatever comes next
            try:
                revision = self._digest()
                self._rows = files.staged(self.read(self.spark, self.path))
            except Exception as error:
                raise Unavailable(f"{self.path} cannot be used") from error
            if self.signature() != seen:
                raise Unavailable(f"{self.path} changed while it was read")
            self._revision, self._signature = revision, seen
        return self._rows

    def revision(self) -> str:
        self.rows()
        return self._revision
