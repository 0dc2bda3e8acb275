"""A data source of clip files in folders by person and day: ``spark.read.format("clip_tree").load(root)``.

The tree is ``A<n>_<NAME>/DAY<d>/<clip>.mp4``. Each folder of a person and day is one partition; equality and IN filters on ``person``
and ``day`` choose folders before any is listed (``spark.sql.python.filterPushdown.enabled``). As a stream, files that are newer than
those seen come in. Folders are listed by Arrow's file systems (local, HDFS, S3, GCS), by the tasks; contents are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..functions.times import clip_parts, clip_start, day_label, stem

SCHEMA = "path string, file string, person string, who string, day string, size long, modified timestamp"
SUFFIX = r"(?i)\.mp4$"
PERSON, DAY = r"(A\d+)_(.+)", r"(DAY\d+)"


@dataclass
class Folder(InputPartition):
    """A day's folder, and which of its files are wanted, by their time in microseconds."""

    path: str
    person: str
    who: str
    day: str
    after: int = -1
    until: int = 1 << 62


@dataclass
class _Tree:
    root: str
    person: str
    day: str
    suffix: str

    @classmethod
    def of(cls, options) -> _Tree:
        if "path" not in options:
            raise ValueError("clip_tree needs a path")
        return cls(options["path"], options.get("personPattern", PERSON), options.get("dayPattern", DAY), options.get("filePattern", SUFFIX))

    def _below(self, path: str, folders: bool) -> list:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
        found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
        wanted = fs.FileType.Directory if folders else fs.FileType.File
        return sorted((f for f in found if f.type == wanted), key=lambda f: f.base_name)

    def folders(self, people: set[str] | None = None, days: set[str] | None = None) -> Iterator[Folder]:
        """Folders of the wanted people and days; a person who is not wanted is not listed."""
        root = self.root.rstrip("/")
        for who in self._below(root, True):
            named = re.fullmatch(self.person, who.base_name)
            if named and (people is None or named[1] in people):
                above = f"{root}/{who.base_name}"
                for day in self._below(above, True):
                    dated = re.fullmatch(self.day, day.base_name)
                    if dated and (days is None or dated[1] in days):
                        yield Folder(f"{above}/{day.base_name}", named[1], named[2], dated[1])

    def files(self, folder: Folder) -> Iterator[tuple]:
        for f in self._below(folder.path, False):
            time = f.mtime_ns // 1000 if f.mtime_ns is not None else 0
            if re.search(self.suffix, f.base_name) and folder.after < time <= folder.until:
                yield f"{folder.path}/{f.base_name}", f.base_name, folder.person, folder.who, folder.day, f.size, f.mtime

    def newest(self) -> int:
        return max((f.mtime_ns // 1000 for folder in self.folders() for f in self._below(folder.path, False) if re.search(self.suffix, f.base_name)), default=-1)


class _Reader(DataSourceReader):
    def __init__(self, tree: _Tree):
        self.tree, self.wanted = tree, {"person": None, "day": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and IN lists on folder columns; gives the others back."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in self.wanted:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = values if self.wanted[column] is None else self.wanted[column] & values

    def partitions(self) -> list[Folder]:
        return list(self.tree.folders(self.wanted["person"], self.wanted["day"]))

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.tree.files(partition) if isinstance(partition, Folder) else iter(())


class _StreamReader(DataSourceStreamReader):
    """The offset is the time of the newest file; files whose time lies between two offsets are a batch."""

    def __init__(self, tree: _Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"modified_us": -1}

    def latestOffset(self) -> dict:
        return {"modified_us": self.tree.newest()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f.path, f.person, f.who, f.day, start["modified_us"], end["modified_us"]) for f in self.tree.folders()]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.tree.files(partition)

    def commit(self, end: dict) -> None:
        pass


class ClipTree(DataSource):
    """Options: path; personPattern (two groups: id, name), dayPattern (one), filePattern."""

    @classmethod
    def name(cls) -> str:
        return "clip_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Tree.of(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Tree.of(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed down to its folders."""
    spark.dataSource.register(ClipTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def named_clips(files: DataFrame) -> DataFrame:
    """Adds ``name`` and ``start``, and takes day, person and who from the clip's name; where it lacks them, they stay the folder's."""
    rows = files.withColumn("name", stem(F.col("file"))).withColumn("p", clip_parts(F.col("name")))
    own = lambda part, else_: F.coalesce(F.nullif(part, F.lit("")), F.col(else_))
    return rows.select("path", "name", own(day_label(F.col("name")), "day").alias("day"), own(F.col("p.person"), "person").alias("person"), own(F.col("p.who"), "who").alias("who"), clip_start(F.col("name")).alias("start"), "size", "modified")
