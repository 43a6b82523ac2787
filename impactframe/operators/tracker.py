"""Tracked directories: scan against a baseline, commit and undo.

States are Parquet, one immutable folder a revision; contents are objects, stored once by their hash and appended where they
are new. Each revision's record names the one before, and a pointer file that is replaced in one step names the current one,
so a failed commit leaves the baseline as it was. The store may lie on any file system that Spark knows.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.functions.text import content_snapshot, file_diff, matches_patterns, under
from impactframe.operators.compare import by_status, compare, has_text_diff, working_revision
from impactframe.sources.directory import read_directory
from impactframe.sources.storage import Storage
from impactframe.session import cut, exists

STATE = "path string, file_exists boolean, size_bytes bigint, mtime double, sha256 string"
OBJECT = "key string, content binary"


class BaselineError(RuntimeError):
    """The stored baseline cannot be read."""


class RevisionConflict(RuntimeError):
    """The baseline or the working tree is not what the caller saw."""


@dataclass(frozen=True)
class Scan:
    """A change set: `changes` with both contents captured when it was made, and the two revisions."""

    changes: DataFrame
    baseline_revision: str
    working_revision: str

    def by_status(self, status: str) -> DataFrame:
        return by_status(self.changes, status)

    def diffs(self) -> DataFrame:
        """(path, diff), empty where a side is neither text nor absent."""
        text = has_text_diff(F.col("old_availability"), F.col("new_availability"))
        return self.changes.select("path", F.when(text, file_diff("path", "old_text", "new_text")).otherwise("").alias("diff"))


class Tracker:
    """One directory and its baseline, `<root>/.impactframe/baseline` unless given."""

    def __init__(self, spark: SparkSession, root: str, baseline: str | None = None, includes: list[str] | None = None, excludes: list[str] | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        given = baseline or os.path.join(self.root, ".impactframe", "baseline")
        self.storage = Storage(spark, given if "://" in given else os.path.abspath(given))
        self.store = self.storage.root
        self.includes, self.excludes = includes or [], excludes or []

    # baseline

    def _record(self, revision: str) -> dict:
        try:
            found = json.loads(self.storage.read("revisions", f"{revision}.json"))
            found["revision"], found["parent"]  # noqa: B018
            return found
        except (ValueError, KeyError, TypeError, Py4JError) as error:
            raise BaselineError(f"unreadable record of revision {revision} in {self.store}") from error

    def manifest(self) -> dict:
        """The current revision's record; without one the baseline is `initial` and empty. A broken one is an error."""
        if not self.storage.exists("current"):
            return {"revision": "initial", "parent": None}
        revision = self.storage.read("current").strip()
        return {"revision": "initial", "parent": None} if revision == "initial" else self._record(revision)

    def _folder(self, revision: str) -> str:
        return self.storage.at("revisions", revision)

    def baseline_states(self) -> DataFrame:
        revision = self.manifest()["revision"]
        if revision == "initial":
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self._folder(revision))

    def objects(self) -> DataFrame:
        """(key, content) of every stored content by its hash."""
        return self.spark.read.schema(OBJECT).parquet(self.storage.at("objects")) if self.storage.exists("objects") else self.spark.createDataFrame([], OBJECT)

    def baseline_contents(self, paths: DataFrame) -> DataFrame:
        """(path, availability, text) of the wanted paths (path) in the baseline: absent, unreadable, or by its bytes."""
        states = paths.select("path").join(self.baseline_states().where("file_exists"), "path", "left").withColumn("key", F.col("sha256"))
        stored = read_objects(states.where("key is not null"), self.objects())
        found = states.join(stored, "key", "left").withColumn("c", content_snapshot(F.col("content")))
        absent = F.col("file_exists").isNull()
        return found.select("path", F.when(absent, "absent").otherwise(F.col("c.availability")).alias("availability"), F.when(~absent, F.col("c.text")).alias("text"))

    def working_states(self) -> DataFrame:
        """Files of the directory; patterns are handed to the source, so that files out of scope are not read."""
        return self._in_scope(read_directory(self.spark, self.root, [self.store], self.includes, self.excludes))

    def _in_scope(self, states: DataFrame) -> DataFrame:
        relative = ".." if "://" in self.store else os.path.relpath(self.store, self.root)
        rows = states.where(matches_patterns(F.col("path"), self.includes, self.excludes))
        return rows if relative.startswith("..") else rows.where(~under(F.col("path"), relative.replace(os.sep, "/")))

    def scan(self) -> Scan:
        """Added, modified and deleted files; contents are captured now, so later edits do not leak in."""
        old, new = self._in_scope(self.baseline_states()), cut(self.working_states())
        here = lambda df: df.where("file_exists").withColumn("content", F.col("content") if "content" in df.columns else F.lit(None).cast("binary"))
        found = compare(here(old), here(new), ["path"], "sha256", ["size_bytes", "mtime", "content"]).drop("old_content")
        stored = self.objects().dropDuplicates(["key"]).select(F.col("key").alias("old_sha256"), F.col("content").alias("old_content"))
        found = found.join(stored, "old_sha256", "left")
        side = lambda p, gone: F.when(F.col("status") == gone, F.struct(F.lit("absent").alias("availability"), F.lit(None).cast("string").alias("text"))).otherwise(content_snapshot(F.col(f"{p}_content")))
        changes = found.withColumn("o", side("old", "added")).withColumn("n", side("new", "deleted")).select(
            "path", "status", "old_sha256", "new_sha256", "old_size_bytes", "new_size_bytes",
            F.col("o.availability").alias("old_availability"), F.col("o.text").alias("old_text"),
            F.col("n.availability").alias("new_availability"), F.col("n.text").alias("new_text"),
        )
        return Scan(cut(changes), self.manifest()["revision"], self._revision(new))

    def _revision(self, states: DataFrame) -> str:
        row = working_revision(states.where("file_exists"), []).first()
        return row.revision if row else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no files

    def commit(self, message: str = "", expected_revision: str | None = None, expected_baseline: str | None = None) -> str:
        """Make the working tree the baseline and return the new revision; a new one is made even without changes."""
        now = self.manifest()
        if expected_baseline is not None and expected_baseline != now["revision"]:
            raise RevisionConflict("the baseline has moved on")
        states = cut(self.working_states())
        if expected_revision is not None and expected_revision != self._revision(states):
            raise RevisionConflict("the working tree has changed since the scan")
        revision = uuid.uuid4().hex
        here = states.where("file_exists")
        store_objects(here.where("sha256 is not null").select(F.col("sha256").alias("key"), "content"), self.storage.at("objects"), self.spark)
        here.select(*[c.split()[0] for c in STATE.split(", ")]).write.parquet(self._folder(revision))
        record = {"revision": revision, "parent": now["revision"], "message": message, "committed_at": datetime.now(timezone.utc).isoformat()}
        self.storage.write(json.dumps(record), "revisions", f"{revision}.json")
        self.storage.write(revision, "current")
        return revision

    def undo(self) -> bool:
        """Go back to the baseline before the last commit; False where there is none. Files stay untouched."""
        parent = self.manifest()["parent"]
        if parent is None:
            return False
        self.storage.write(parent, "current")
        return True


def new_objects(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per key of objects (key, ...) that is not stored yet."""
    return objects.dropDuplicates(["key"]).join(stored.select("key"), "key", "left_anti")


def read_objects(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, content) of each wanted key, content null where it is not stored."""
    return keys.select("key").distinct().join(stored.select("key", "content").dropDuplicates(["key"]), "key", "left")


def store_objects(objects: DataFrame, path: str, spark: SparkSession) -> int:
    """Append contents (key, content) whose key is not stored yet; returns how many there are to add. Idempotent."""
    wanted = objects.select("key", "content")
    there = spark.read.parquet(path) if exists(spark, path) else wanted.limit(0)
    fresh = cut(new_objects(wanted, there))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n
