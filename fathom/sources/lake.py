"""A data source that lists the files of a lake, as a table and as a stream.

``spark.read.format("lake").option("root", ...)`` has a row for each file, empty ones too,
sorted by path; tasks list a folder each.  As a stream, a trigger covers a span of time: tasks
list the files that were changed in it, so a file that changes is met again, and nothing is
listed by the driver.  The store must be one that Arrow's file systems reach.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fathom.sources.files import safe_prefix

SCHEMA = "relative_path string, filename string, extension string, size_bytes long, last_modified timestamp"
#: Seconds by which a stream stays behind the clock, for files that are still being written.
LAG = 2.0


class Folder(InputPartition):
    """A folder below the root, with what is below it or not, and a span of time."""

    def __init__(self, path: str, deep: bool, after: float | None = None, until: float | None = None) -> None:
        self.path, self.deep, self.after, self.until = path, deep, after, until


def _store(root: str):
    from pyarrow import fs

    at = root.rstrip("/")
    uri = re.sub(r"^file:/+", "file:///", at) if re.match(r"^[A-Za-z0-9+.\-]+:", at) else "file://" + at
    return fs.FileSystem.from_uri(uri)


class Lister:
    def __init__(self, options: dict) -> None:
        self.root, self.prefix = options["root"], safe_prefix(options.get("prefix", ""))
        self.lag = float(options.get("lag", LAG))

    def folders(self, after: float | None = None, until: float | None = None) -> list[Folder]:
        """The prefix itself without what is below it, and each folder right below it.  A
        prefix may be a single file; one that isn't there has no files."""
        from pyarrow import fs

        store, base = _store(self.root)
        top = f"{base}/{self.prefix}".rstrip("/")
        kind = store.get_file_info(top).type
        if kind == fs.FileType.NotFound:
            return []
        below = [] if kind == fs.FileType.File else store.get_file_info(fs.FileSelector(top))
        found = [Folder(x.path, True, after, until) for x in below if x.type == fs.FileType.Directory]
        return [Folder(top, False, after, until), *sorted(found, key=lambda f: f.path)]

    def rows(self, folder: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = _store(self.root)
        info = store.get_file_info(folder.path)
        every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder.path, recursive=folder.deep, allow_not_found=True))
        for x in sorted((x for x in every if x.type == fs.FileType.File), key=lambda x: x.path):
            at = x.mtime_ns / 1e9 if x.mtime_ns is not None else 0.0
            if (folder.after is None or at > folder.after) and (folder.until is None or at <= folder.until):
                name = x.base_name
                dot = name.rfind(".")
                suffix = name[dot:].lower() if dot > 0 else ""
                changed = datetime.fromtimestamp(int(at * 1000) / 1000, timezone.utc)
                yield x.path[len(base.rstrip("/")) + 1 :], name, suffix, x.size, changed


class LakeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.lister = Lister(options)

    def partitions(self) -> list[Folder]:
        return self.lister.folders() or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.lister.rows(partition) if partition.path else iter(())


class LakeStream(DataSourceStreamReader):
    """Offsets are times; a span is open at its begin and closed at its end."""

    def __init__(self, options: dict) -> None:
        self.lister = Lister(options)

    def initialOffset(self) -> dict:
        return {"time": 0.0}

    def latestOffset(self) -> dict:
        return {"time": time.time() - self.lister.lag}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.lister.folders(start["time"], end["time"]) or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.lister.rows(partition) if partition.path else iter(())


class Lake(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lake"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LakeReader:
        return LakeReader(self.options)

    def streamReader(self, schema) -> LakeStream:
        return LakeStream(self.options)


def listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """One row per file below ``root/prefix``, empty files too, sorted by path."""
    spark.dataSource.register(Lake)
    found = spark.read.format("lake").option("root", root).option("prefix", prefix).load()
    return found.orderBy("relative_path")


def changes(spark: SparkSession, root: str, prefix: str = "", lag: float = LAG) -> DataFrame:
    """A stream of the files that are there and, from then on, of each that is new or changed."""
    spark.dataSource.register(Lake)
    return spark.readStream.format("lake").option("root", root).option("prefix", prefix).option("lag", str(lag)).load()
