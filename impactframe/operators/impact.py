"""Change impact: from two source sets to the entry points that each function change reaches, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.functions.text import function_diff
from impactframe.operators.compare import compare, edge_changes, overlay
from impactframe.operators.facts import EXTENSIONS, Facts, analyze
from impactframe.operators.graph import closure, components, upstream
from impactframe.session import cut


@dataclass(frozen=True)
class Impact:
    """Function changes, edge changes, evidence per (entry, change), changes that reach no entry, snapshot issues."""

    function_changes: DataFrame
    edge_changes: DataFrame
    evidence: DataFrame
    unassigned: DataFrame
    issues: DataFrame | None
    old: Facts
    new: Facts


def function_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(function_id, change_type, old_*, new_*, diff) of functions whose source differs."""
    carry = ["source_id", "start_line", "end_line"]
    found = compare(old, new, ["id"], "source", carry).withColumnRenamed("id", "function_id").withColumnRenamed("status", "change_type")
    return found.withColumn("diff", function_diff("old_source_id", "new_source_id", "old_source", "new_source"))


def find_evidence(changes: DataFrame, old_paths: DataFrame, new_paths: DataFrame) -> DataFrame:
    """(entry_id, changed_function_id, change_type, reason, old_path, new_path), one row per entry that a change reaches.

    The paths are closures from all entries of each side (root, node, path); an entry that itself changed is its own
    evidence.
    """
    side = lambda p, name: p.select(F.col("root").alias("entry_id"), F.col("node").alias("changed_function_id"), F.col("path").alias(name))
    reach = side(old_paths, "old_path").join(side(new_paths, "new_path"), ["entry_id", "changed_function_id"], "full_outer")
    changed = changes.select(F.col("function_id").alias("changed_function_id"), "change_type")
    own = F.col("entry_id") == F.col("changed_function_id")
    reason = F.concat(F.when(own, F.lit("entry_")).otherwise(F.lit("reachable_function_")), F.col("change_type"))
    return reach.join(changed, "changed_function_id").select(
        "entry_id", "changed_function_id", "change_type", reason.alias("reason"), "old_path", "new_path"
    )


def resolved_edges(calls: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the calls that resolved, whether or not the target is known."""
    return calls.where(F.col("target_id").isNotNull()).select(F.col("source_fn").alias("src"), F.col("target_id").alias("dst")).distinct()


def affected_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entry_id): entries that a change reaches on either side; old and new: (entry_id, ...)."""
    return old.select("entry_id").union(new.select("entry_id")).distinct()


def unassigned(changes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Function changes (function_id, ...) that reach no entry."""
    return changes.join(evidence.select(F.col("changed_function_id").alias("function_id")), "function_id", "left_anti")


def _paths(facts: Facts, changes: DataFrame) -> DataFrame:
    """Closures from the entries that can reach a change, over the functions that can; no other path is walked."""
    edges = facts.edges()
    near = upstream(edges, changes.select(F.col("function_id").alias("node")))
    within = lambda c: near.withColumnRenamed("node", c)
    inner = edges.join(within("src"), "src", "left_semi").join(within("dst"), "dst", "left_semi")
    return closure(inner, facts.entry_points.select(F.col("function_id").alias("root")).join(within("root"), "root", "left_semi"))


def impact_of(old: Facts, new: Facts, issues: DataFrame | None = None) -> Impact:
    """Compare the facts of two snapshots (each of one scope)."""
    changes = cut(function_changes(old.functions, new.functions))
    evidence = find_evidence(changes, _paths(old, changes), _paths(new, changes))
    evidence = cut(evidence)
    edges = edge_changes(resolved_edges(old.calls), resolved_edges(new.calls), ["src", "dst"])
    return Impact(changes, edges, evidence, unassigned(changes, evidence), issues, old, new)


def scoped(facts: Facts) -> Facts:
    """The same facts with their scope at the head of every id, so that several scopes can be compared at once."""
    at = lambda df, *columns: df.withColumns({c: F.concat("scope", F.lit("|"), c) for c in columns}).withColumn("scope", F.lit(""))
    return Facts(at(facts.functions, "id"), at(facts.calls, "source_fn", "target_id"), at(facts.entry_points, "function_id"), at(facts.diagnostics, "function_id"))


def analyze_changes(working: DataFrame, changes: DataFrame, analyzers: dict = EXTENSIONS) -> Impact:
    """Impact of a scan: `changes` as for compare.overlay, `working` the full working sources."""
    before, after, issues = overlay(working, changes)
    return impact_of(analyze(before, analyzers), analyze(after, analyzers), issues)


def batches(evidence: DataFrame) -> DataFrame:
    """(component, kind, id): entries and changed functions that hang together, as membership rows.

    A batch's lists are the sorted ids of its component; they are left as rows because a component may hold any number.
    """
    entry = F.concat(F.lit("entry\x1f"), "entry_id")
    function = F.concat(F.lit("function\x1f"), "changed_function_id")
    found = components(evidence.select(entry.alias("a"), function.alias("b")))
    part = lambda c, i: F.split(F.col(c), "\x1f").getItem(i)
    return found.select(part("component", 1).alias("component"), part("node", 0).alias("kind"), part("node", 1).alias("id"))


def entry_contexts(impact: Impact) -> dict[str, DataFrame]:
    """Per entry with evidence: its context functions of either side, the edge changes that touch them, and the diagnostics of
    either side about them, each once."""
    entries = impact.evidence.select(F.col("entry_id").alias("root")).distinct()
    ids = told = None
    for facts in (impact.old, impact.new):
        there = entries.join(facts.entry_points.select(F.col("function_id").alias("root")).distinct(), "root", "left_semi")
        found = closure(facts.edges(), there).select("root", "node")
        about = facts.diagnostics.drop("scope").join(found.withColumnRenamed("node", "function_id"), "function_id")
        ids = found if ids is None else ids.unionByName(found).distinct()
        told = about if told is None else told.unionByName(about).distinct()
    touch = lambda c: impact.edge_changes.join(ids.withColumnRenamed("node", c), c).select("root", "src", "dst", "change_type")
    return {"functions": ids, "edge_changes": touch("src").unionByName(touch("dst")).distinct(), "diagnostics": told}
