"""Small files and folders of stores, through Hadoop paths: the same code on a local disk and on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Storage:
    """File operations below one root, a path or URI of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        self.root = root.rstrip("/") or "/"
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path().getFileSystem(self.conf)

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def at(self, *parts: str) -> str:
        """The full path of something below the root, for Spark's readers and writers."""
        return "/".join((self.root, *parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._path(*parts))

    def names(self, *parts: str) -> list[str]:
        """Names in a folder in order; none where there is no folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(*parts))) if self.exists(*parts) else []

    def folder(self, *parts: str) -> None:
        self.fs.mkdirs(self._path(*parts))

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self._path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """Write a file by a temporary one that replaces it in one step."""
        part = (*parts[:-1], f".tmp-{uuid.uuid4().hex}")
        stream = self.fs.create(self._path(*part), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.conf)
        context.rename(self._path(*part), self._path(*parts), options)

    def rename(self, name: str, *parts: str) -> None:
        """Move an entry of the root to a place that must be free."""
        if self.exists(*parts) or not self.fs.rename(self._path(name), self._path(*parts)):
            raise FileExistsError(self.at(*parts))

    def delete(self, *parts: str) -> None:
        """Delete a file, or a folder with everything in it."""
        self.fs.delete(self._path(*parts), True)

    def delete_empty(self, *parts: str) -> None:
        """Delete a folder; OSError where anything is left in it."""
        left = self.names(*parts)
        if left:
            raise OSError(f"{self.at(*parts)} still holds {', '.join(left)}")
        self.fs.delete(self._path(*parts), False)
