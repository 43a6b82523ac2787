"""Checkpointed document work: tasks are saved in order, assembled into documents and published.

State is an append-only log of folders in a store: each task, each finished document and the freeze mark is one Parquet
folder or file that appears by rename, so an interrupted step leaves nothing half done and a rerun skips what
is recorded.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impactframe.operators.fragments import NAMESPACE, apply_operations
from impactframe.sources.storage import Storage

OPS = "document_key string, task_id string, task_no bigint, seq bigint, fragment_id string, kind string, markdown string"
DONE = "document_key string, text string, bytes bigint, sha256 string"


#: Names of committed folders: a number and a hash.
_COMMITTED = re.compile(r"\d{12}-[0-9a-f]{32}")


def _overlap(a: str, b: str) -> bool:
    """Whether one path is or holds the other; paths of different file systems never do."""
    a, b = ((p if "://" in p else os.path.abspath(p)).rstrip("/") + "/" for p in (a, b))
    return a.startswith(b) or b.startswith(a)


class WorkbenchError(RuntimeError):
    """The store refuses a step: duplicate, frozen, closed or corrupt."""


def key_errors(keys: DataFrame) -> DataFrame:
    """(document_key, error) of keys that are no relative POSIX path, differ in letter case from another, or are both a
    file and a directory. Prefixes are exploded and grouped; keys are never compared in pairs."""
    k = F.col("document_key")
    parts = F.split(k, "/")
    bad = k.isNull() | (k == "") | k.startswith("/") | k.rlike(r"\\|//|/$|(^|/)\.{1,2}(/|$)")
    malformed = keys.where(bad).select("document_key", F.lit("not a relative POSIX path").alias("error"))
    fine = keys.where(~bad).select("document_key").distinct()
    prefixes = fine.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).select(
        "document_key", F.array_join(F.slice(parts, 1, F.col("n")), "/").alias("prefix"), (F.col("n") == F.size(parts)).alias("whole")
    )
    cased = prefixes.groupBy(F.lower("prefix").alias("folded")).agg(
        F.min("prefix").alias("a"), F.max("prefix").alias("b"), F.max("whole").alias("file"), F.min("whole").alias("only_file")
    )
    wrong = cased.where("a <> b or (file and not only_file)").select("folded", F.when(F.col("a") != F.col("b"), "differs in letter case").otherwise("file and directory").alias("error"))
    hit = prefixes.withColumn("folded", F.lower("prefix")).join(wrong, "folded").select("document_key", "error").distinct()
    return malformed.unionByName(hit)


def with_integrity(documents: DataFrame) -> DataFrame:
    """(document_key, text, bytes, sha256) of (document_key, text)."""
    return documents.select("document_key", "text", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def corrupt(stored: DataFrame) -> DataFrame:
    """Stored documents whose text does not match its size and hash."""
    return stored.where((F.octet_length("text") != F.col("bytes")) | (F.sha2("text", 256) != F.col("sha256")))


class Workbench:
    """A store below `root`, a path or URI that all executors reach; reopen it to go on after a crash or a failed step."""

    def __init__(self, spark: SparkSession, root: str, protected: list[str] | None = None, namespace: str = NAMESPACE):
        self.spark, self.namespace = spark, namespace
        self.root = root if "://" in root else os.path.abspath(root)
        for other in protected or []:
            if _overlap(other, self.root):
                raise WorkbenchError(f"{self.root} overlaps {other}")
        self.storage = Storage(spark, self.root)
        for folder in ("tasks", "done"):
            self.storage.folder(folder)
        self.open = True
        unknown = [n for n in self.storage.names() if n not in ("tasks", "done", "frozen") and not n.startswith(".tmp")]
        if unknown:
            raise WorkbenchError(f"unknown files in the store: {unknown}")
        self.verify()

    def _need_open(self) -> None:
        if not self.open:
            raise WorkbenchError("the workbench is closed, or a step failed: open it again")

    @property
    def frozen(self) -> bool:
        return self.storage.exists("frozen")

    def _names(self, folder: str) -> list[str]:
        return [n for n in self.storage.names(folder) if _COMMITTED.fullmatch(n)]

    def _task_names(self) -> list[str]:
        return self._names("tasks")

    def _put(self, df: DataFrame, folder: str, name: str) -> None:
        part = f".tmp-{uuid.uuid4().hex}"
        try:
            df.write.parquet(self.storage.at(part))
            self.storage.rename(part, folder, name)  # atomic; fails where the name is taken
        except Exception:
            self.open = False  # what the store holds is known again once it is reopened
            raise

    # tasks

    def save_task(self, document_key: str, task_id: str, results: DataFrame) -> None:
        """Record the ordered results (seq, fragment_id, kind, markdown) of a task once; refused when frozen or repeated."""
        self._need_open()
        if self.frozen:
            raise WorkbenchError("tasks are frozen once a document is saved")
        if not task_id or task_id != task_id.strip() or re.search(r"[\r\n]", task_id):
            raise WorkbenchError("task_id must be a non-empty single line")
        digest = hashlib.sha256(f"{document_key}\0{task_id}".encode()).hexdigest()[:32]
        names = self._task_names()
        if any(n.endswith(digest) for n in names):
            raise WorkbenchError(f"task {task_id!r} of {document_key!r} is already saved")
        rows = results.select(
            F.lit(document_key).alias("document_key"), F.lit(task_id).alias("task_id"), F.lit(len(names)).cast("bigint").alias("task_no"),
            F.col("seq").cast("bigint").alias("seq"), "fragment_id", "kind", "markdown",
        )
        self._put(rows, "tasks", f"{len(names):012d}-{digest}")

    def tasks(self) -> DataFrame:
        """All operations, numbered per document in save order of the tasks."""
        names = self._task_names()
        if not names:
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(*[self.storage.at("tasks", n) for n in names])

    def contains(self, document_key: str) -> bool:
        return not self.results().where(F.col("document_key") == document_key).isEmpty()

    def contains_task(self, document_key: str, task_id: str) -> bool:
        return not self.tasks().where((F.col("document_key") == document_key) & (F.col("task_id") == task_id)).isEmpty()

    # documents

    def results(self) -> DataFrame:
        """(document_key, text, bytes, sha256) of the finished documents."""
        names = self._names("done")
        if not names:
            return self.spark.createDataFrame([], DONE)
        return self.spark.read.schema(DONE).parquet(*[self.storage.at("done", n) for n in names])

    def save(self, documents: DataFrame) -> int:
        """Record (document_key, text) that are not finished yet and freeze the tasks; a finished one is never replaced."""
        self._need_open()
        fresh = documents.select("document_key", "text").join(self.results().select("document_key"), "document_key", "left_anti")
        errors = key_errors(fresh.select("document_key").unionByName(self.results().select("document_key")))
        first = errors.first()
        if first:
            raise WorkbenchError(f"{first.document_key!r}: {first.error}")
        if not self.frozen:
            self.storage.write("", "frozen")
        self._put(with_integrity(fresh), "done", f"{len(self._names('done')):012d}-{uuid.uuid4().hex}")
        return fresh.count()

    def verify(self) -> None:
        """Refuse a store whose finished documents do not match their size and hash."""
        bad = corrupt(self.results()).first()
        if bad:
            raise WorkbenchError(f"stored document {bad.document_key!r} is corrupt")

    def assemble(self, originals: DataFrame) -> int:
        """Fold the tasks into the originals (document_key, text; a missing one is empty) and save what is not finished."""
        self._need_open()
        ops = self.tasks().join(self.results().select("document_key"), "document_key", "left_anti")
        order = Window.partitionBy("document_key").orderBy("task_no", "seq")
        ops = ops.withColumn("seq", F.row_number().over(order).cast("bigint"))
        keys = ops.select("document_key").distinct()
        texts = keys.join(originals.select("document_key", "text"), "document_key", "left").withColumn("text", F.coalesce("text", F.lit("")))
        return self.save(apply_operations(texts, ops, self.namespace).select("document_key", "text"))

    def publish(self, directory: str) -> list[str]:
        """Assemble what is missing, verify, write each document by temporary file and rename, then remove the store.

        The directory is a path that all executors share. Originals are read and documents written where their rows are;
        the driver sees names alone.
        """
        self._need_open()
        target = os.path.abspath(directory)
        if _overlap(target, self.root):
            raise WorkbenchError(f"{target} overlaps the store")

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(text=[_read(os.path.join(target, k)) for k in frame.document_key])

        keys = self.tasks().select("document_key").distinct()
        self.assemble(keys.mapInPandas(read, "document_key string, text string"))
        self.verify()

        def write(rows) -> None:
            for row in rows:
                path = os.path.join(target, row.document_key)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(row.text)
                os.replace(part, path)

        self.results().foreachPartition(write)
        published = sorted(r.document_key for r in self.results().select("document_key").toLocalIterator())
        self.close()
        self._remove()
        return published

    def _remove(self) -> None:
        """Delete what was committed and unfinished steps, nothing else; WorkbenchError where something else is left."""
        for folder in ("tasks", "done"):
            for name in self._names(folder):
                self.storage.delete(folder, name)
        for name in self.storage.names():
            if name == "frozen" or name.startswith(".tmp-"):
                self.storage.delete(name)
        try:
            for folder in (("tasks",), ("done",), ()):
                self.storage.delete_empty(*folder)
        except OSError as error:
            raise WorkbenchError(str(error)) from error

    def close(self) -> None:
        self.open = False

    def __enter__(self) -> Workbench:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except FileNotFoundError:
        return ""
