"""A directory as a table: one row per file with size, time, hash and bytes, dot and underscore names included."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, file_exists boolean, size_bytes bigint, mtime double, sha256 string, content binary"


class _Files(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class _Reader(DataSourceReader):
    """Lists the tree once on the driver, pruned directories unvisited; files are read by the tasks."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.pruned = {os.path.abspath(p) for p in options.get("prune", "").split("\n") if p}
        self.includes = [p for p in options.get("includes", "").split("\n") if p]
        self.excludes = [p for p in options.get("excludes", "").split("\n") if p]
        self.size = int(options.get("filesPerPartition", "512"))

    def partitions(self) -> list[_Files]:
        found: list[str] = []
        for folder, names, files in os.walk(self.root):
            names[:] = sorted(n for n in names if os.path.join(folder, n) not in self.pruned)
            found += [p for p in (os.path.relpath(os.path.join(folder, f), self.root) for f in files) if self._wanted(p.replace(os.sep, "/"))]
        found.sort()
        return [_Files(self.root, found[i : i + self.size]) for i in range(0, len(found), self.size)] or [_Files(self.root, [])]

    def _wanted(self, path: str) -> bool:
        hit = lambda p: fnmatch.fnmatchcase(path, p) or (p.startswith("**/") and fnmatch.fnmatchcase(path, p[3:]))
        return (not self.includes or any(map(hit, self.includes))) and not any(map(hit, self.excludes))

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            name = path.replace(os.sep, "/")
            try:
                full = os.path.join(partition.root, path)
                stat = os.stat(full)
            except OSError:
                yield name, False, None, None, None, None
                continue
            try:
                digest, data = hashlib.sha256(), bytearray()
                with open(full, "rb") as f:
                    while block := f.read(1 << 16):
                        digest.update(block)
                        data += block
                yield name, True, stat.st_size, stat.st_mtime, digest.hexdigest(), bytes(data)
            except OSError:
                yield name, True, stat.st_size, stat.st_mtime, None, None


class DirectorySource(DataSource):
    """Format `impact_directory`; options path, prune (one directory a line), includes and excludes (one shell pattern a
    line, whose `*` crosses `/`), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "impact_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_directory(spark: SparkSession, root: str, prune: list[str] | None = None, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """(path, file_exists, size_bytes, mtime, sha256, content) of every file below root that the patterns let through.

    Where a file vanishes the row stays with file_exists false and nulls; an unreadable one has null hash and content.
    """
    from impactframe.session import ship

    ship(spark)
    spark.dataSource.register(DirectorySource)
    return spark.read.format("impact_directory").option("prune", "\n".join(prune or [])).option("includes", "\n".join(includes or [])).option("excludes", "\n".join(excludes or [])).load(os.path.abspath(root))
