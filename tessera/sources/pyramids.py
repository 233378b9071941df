"""The levels and properties of image pyramids, from the directories of TIFF files: a few kilobytes of each file are read, no pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, width long, height long, level_widths array<long>, level_heights array<long>, properties map<string,string>, error string"
#: TIFF field types by number: letter for struct and bytes (fixed values of the format).
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("c", 1), 8: ("h", 2), 9: ("i", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
#: Tags that are read (fixed values of the format).
_WIDTH, _HEIGHT, _DESCRIPTION, _TILE_WIDTH = 256, 257, 270, 322
#: The most directories of a file and the longest text of a tag; a file beyond them is damaged.
_DIRECTORIES, _TEXT = 1000, 1 << 20


class Damaged(ValueError):
    pass


def _exactly(file, at: int, n: int) -> bytes:
    if at < 0 or at + n > file.size():
        raise Damaged("cut off")
    file.seek(at)
    return file.read(n)


def directories(file) -> Iterator[dict[int, int | str]]:
    """The wanted tags of each directory of a TIFF or BigTIFF file, in order."""
    head = _exactly(file, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise Damaged("no TIFF file")
    big = version == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    size, counted = struct.calcsize(f"{order}{word}"), struct.calcsize(f"{order}{count}")
    at = struct.unpack(f"{order}Q", _exactly(file, 8, 8))[0] if big else struct.unpack(f"{order}I", head[4:])[0]
    seen: set[int] = set()
    while at:
        if at in seen or len(seen) >= _DIRECTORIES:
            raise Damaged("directories run in a circle")
        seen.add(at)
        n = struct.unpack(f"{order}{count}", _exactly(file, at, counted))[0]
        raw, tags = _exactly(file, at + counted, n * entry + size), {}
        for k in range(n):
            tag, kind, length = struct.unpack_from(f"{order}HH{word}", raw, k * entry)
            if tag not in (_WIDTH, _HEIGHT, _DESCRIPTION, _TILE_WIDTH) or kind not in _TYPES:
                continue
            letter, width = _TYPES[kind]
            if length * width > _TEXT:
                raise Damaged("a tag is too long")
            field = raw[k * entry + 4 + size : k * entry + 4 + 2 * size]
            data = field if length * width <= size else _exactly(file, struct.unpack(f"{order}{word}", field)[0], length * width)
            tags[tag] = data[:length].split(b"\0")[0].decode("utf-8", "replace") if letter == "c" else struct.unpack_from(f"{order}{letter}", data)[0]
        yield tags
        at = struct.unpack_from(f"{order}{word}", raw, n * entry)[0]


def properties_of(description: str) -> dict[str, str]:
    """The name = value pairs of a description, parts of which are set apart by bars, and the names that the property rules know."""
    own = {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in description.split("|")[1:] if "=" in p)}
    known = {"tiffslide.mpp-x": own.get("MPP"), "tiffslide.mpp-y": own.get("MPP"), "tiffslide.objective-power": own.get("AppMag"), "tiffslide.vendor": "aperio" if description.startswith("Aperio") else None}
    return own | {k: v for k, v in known.items() if v is not None}


def described(file) -> tuple:
    """The fields of SCHEMA after the path. Levels are the tiled images, which get no larger; the first image is the slide."""
    found = list(directories(file))
    if not found or _WIDTH not in found[0] or _HEIGHT not in found[0]:
        raise Damaged("no image")
    tiled = [d for d in found if _TILE_WIDTH in d and _WIDTH in d and _HEIGHT in d] or found[:1]
    levels = [d for k, d in enumerate(tiled) if d[_WIDTH] <= tiled[max(0, k - 1)][_WIDTH]]
    if min(x[s] for x in levels for s in (_WIDTH, _HEIGHT)) < 1:
        raise Damaged("an empty level")
    return levels[0][_WIDTH], levels[0][_HEIGHT], [d[_WIDTH] for d in levels], [d[_HEIGHT] for d in levels], properties_of(str(found[0].get(_DESCRIPTION, ""))), None


class _Paths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.each = options["path"], int(options.get("files_per_partition", 100))

    def partitions(self) -> list[InputPartition]:
        fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
        kept = lambda p: p.lower().endswith((".svs", ".tif", ".tiff"))
        info = fs.get_file_info(path)
        files = [path] if info.is_file else sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)) if x.is_file and kept(x.path))
        return [_Paths(files[k : k + self.each]) for k in range(0, len(files), self.each)]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            try:
                with fs.open_input_file(path) as file:
                    yield (path, *described(file))
            except (Damaged, OSError, struct.error) as error:
                yield path, None, None, None, None, None, f"{type(error).__name__}: {error}"


class Pyramids(DataSource):
    """spark.read.format("pyramids").load(folder): a row for each TIFF file below a folder in any store that Arrow's file systems reach;
    files_per_partition (100) of them are one partition. A file that is no TIFF, cut off or unreadable is a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "pyramids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pyramids(spark: SparkSession, folder: str, files_per_partition: int = 100) -> DataFrame:
    """The rows of a folder's files; a path without a scheme is one of the machine."""
    spark.dataSource.register(Pyramids)
    return spark.read.format("pyramids").option("files_per_partition", files_per_partition).load(folder if ":" in folder else f"file://{folder}")


def planned_levels(pyramids: DataFrame, slide_id: Column) -> DataFrame:
    """What tile planning takes of the files that can be read: slide_id, width, height, levels, and the levels' downsamples (the mean of both
    sides' ratios) and sizes."""
    side = lambda whole, own: F.transform(own, lambda x: F.col(whole) / x)
    both = F.zip_with(side("width", "level_widths"), side("height", "level_heights"), lambda a, b: (a + b) / 2)
    return pyramids.where(F.col("error").isNull()).select(slide_id.alias("slide_id"), "width", "height", F.size("level_widths").alias("levels"), both.alias("level_downsamples"), "level_widths", "level_heights")
