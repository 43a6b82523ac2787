"""Comparison of two states by key, overlays, set differences and content revisions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame, keys: list[str], value: str, carry: list[str] | None = None) -> DataFrame:
    """keys, status, old_<c>, new_<c>: added, deleted, and modified where `value` differs (null equals null only).

    One full outer join; keys must be unique on each side (see facts.first_wins), null keys match nothing. Columns other
    than keys, value and carry are ignored, so clashing names do no harm.
    """
    columns = [value, *(c for c in carry or [] if c != value)]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in columns], F.lit(True).alias(f"_{p}"))
    both = side(old, "old").join(side(new, "new"), keys, "full_outer")
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")), "modified")
    )
    changed = both.withColumn("status", status).where("status is not null").drop("_old", "_new")
    return changed.select(*keys, "status", *[f"{p}_{c}" for p in ("old", "new") for c in columns])


def by_status(changes: DataFrame, status: str) -> DataFrame:
    """Changes of one status: added, modified or deleted."""
    if status not in ("added", "modified", "deleted"):
        raise ValueError(f"status must be added, modified or deleted, not {status!r}")
    return changes.where(F.col("status") == status)


def status_counts(changes: DataFrame, *by: str) -> DataFrame:
    return changes.groupBy(*by, "status").agg(F.count("*").alias("n"))


def has_text_diff(old: Column, new: Column) -> Column:
    """Whether both sides can be compared as text: each is text or absent."""
    return old.isin("text", "absent") & new.isin("text", "absent")


def overlay(working: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(baseline, working, issues) source sets that agree with a scan.

    working: (source_id, content, language); changes: (source_id, old_availability, old_text, new_availability,
    new_text[, old_language]). On each side a changed file takes the text of the scan; one that is absent there is
    removed, and one that is neither text nor absent is removed and reported as (source_id, side, availability).
    """
    ids = changes.select("source_id")
    untouched = working.select("source_id", "content", "language").join(ids, "source_id", "left_anti")
    hints = working.select("source_id", F.col("language").alias("hint")).dropDuplicates(["source_id"])
    known = changes.join(hints, "source_id", "left")
    spoken = F.col("hint")
    if "old_language" in changes.columns:
        spoken = F.coalesce(F.col("old_language"), spoken)
    side = lambda p, lang: known.where(F.col(f"{p}_availability") == "text").select(
        "source_id", F.col(f"{p}_text").alias("content"), lang.alias("language")
    )
    issues = None
    for p, label in (("old", "baseline"), ("new", "working")):
        state = F.col(f"{p}_availability")
        bad = changes.where(~state.isin("text", "absent")).select("source_id", F.lit(label).alias("side"), state.alias("availability"))
        issues = bad if issues is None else issues.unionByName(bad)
    return untouched.unionByName(side("old", spoken)), untouched.unionByName(side("new", F.col("hint"))), issues


def edge_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change_type: deleted = old minus new, added = new minus old, each distinct; nulls compare as equal."""
    gone = old.select(*keys).subtract(new.select(*keys)).withColumn("change_type", F.lit("deleted"))
    come = new.select(*keys).subtract(old.select(*keys)).withColumn("change_type", F.lit("added"))
    return gone.unionByName(come)


def working_revision(states: DataFrame, by: list[str], path: str = "path", digest: str = "sha256") -> DataFrame:
    """by, revision: sha256 over `path NUL digest LF` of each group's files in the order of their path components.

    Rows are sorted by shuffle and hashed as a stream, so a group of any size takes constant memory; its hash is
    sequential by definition. Null digests hash as empty text. Without rows there is no group.
    """
    parts = F.split(F.col(path), "/")
    rows = states.select(*by, parts.alias("_parts"), F.concat(F.col(path), F.lit("\0"), F.coalesce(digest, F.lit("")), F.lit("\n")).alias("_line"))
    spread = rows.repartition(*by).sortWithinPartitions(*by, "_parts") if by else rows.repartition(1).sortWithinPartitions("_parts")
    fields = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in by), "revision string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            done = []
            keys = list(zip(*[frame[c] for c in by])) if by else [()] * len(frame)
            for key, line in zip(keys, frame["_line"]):
                if key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(line.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=[*by, "revision"])
        if state is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*by, "revision"])

    return spread.mapInPandas(run, schema)
