"""Graph operators: reachability with canonical paths, bounded contexts, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.operators.ordering import running
from impactframe.session import cut


def neighbours(edges: DataFrame, nodes: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, other): direct successors, or predecessors, of the given nodes; a node is not its own neighbour."""
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).distinct()
    return pairs.where("node <> other").join(nodes.select("node").distinct(), "node", "left_semi")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(root, node, depth, path) for every node reachable from each root, the root itself at depth 0.

    `path` is the least of the shortest paths, so (depth, path) is the order of a breadth-first walk over sorted edges.
    All roots advance together, one level at a time; a level joins the frontier with the edges and keeps one path per
    (root, node). edges: (src, dst), repeated or null ends do no harm; roots: (root).
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must be non-negative")
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    links = cut(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct())
    start = roots.select("root").where("root is not null").distinct()
    frontier = cut(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")))
    levels, seen = [frontier], frontier.select("root", "node")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(links, "node").select("root", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        best = step.groupBy("root", "node").agg(F.min("path").alias("path")).join(seen, ["root", "node"], "left_anti")
        frontier = cut(best.select("root", "node", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("root", "node"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def upstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): the given nodes and every node from which one of them can be reached. One row a node, whatever reaches what."""
    links = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("before")).where("node is not null and before is not null").distinct())
    frontier = cut(nodes.select("node").where("node is not null").distinct())
    rounds, seen = 0, frontier
    while True:
        step = frontier.join(links, "node").select(F.col("before").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        rounds += 1
        seen = seen.unionByName(frontier)
        seen = cut(seen) if rounds % 8 == 0 else seen
    return seen


def reachable(edges: DataFrame, roots: DataFrame, reverse: bool = False) -> DataFrame:
    """(root, node, ord): what each root reaches, itself left out, numbered in breadth-first order."""
    found = closure(edges, roots, reverse=reverse).where("depth > 0")
    return running(found.select("root", "node", "depth", "path"), ["root"], F.struct("depth", "path")).select("root", "node", "ord")


def within_budget(nodes: DataFrame, keys: list[str], order: str, size: str | None, max_rows: int | None, max_size: int | None) -> DataFrame:
    """Rows of each key in order, up to max_rows and as long as the running sum of `size` stays within max_size.

    Adds `kept` and, per row, the first limit that dropped it (`reason`). Sizes must not be negative.
    """
    columns = nodes.columns
    numbered = running(nodes, keys, F.col(order), size)
    over_rows = F.col("ord") > max_rows if max_rows is not None else F.lit(False)
    over_size = F.col("total") > max_size if max_size is not None else F.lit(False)
    reason = F.when(over_rows, "max_functions").when(over_size, "max_source_chars")
    return numbered.withColumn("reason", reason).select(*columns, "reason", F.col("reason").isNull().alias("kept"))


def dependency_context(
    functions: DataFrame, edges: DataFrame, calls: DataFrame, diagnostics: DataFrame, roots: DataFrame,
    max_depth: int | None = None, max_functions: int | None = None, max_source_chars: int | None = None,
) -> dict[str, DataFrame]:
    """{functions, calls, paths, diagnostics, truncation} of what each root needs, cut to the limits.

    Functions are taken in the order of their ids, so a limit may drop the root itself; max_depth never counts as
    truncation. `truncation` holds a row (root, reason) for each limit that cut something.
    """
    if max_functions is not None and max_functions < 1:
        raise ValueError("max_functions must be positive")
    if max_source_chars is not None and max_source_chars < 0:
        raise ValueError("max_source_chars must be non-negative")
    paths = closure(edges, roots, max_depth)
    sized = paths.join(functions.select(F.col("id").alias("node"), F.length("source").alias("chars")), "node")
    judged = cut(within_budget(sized, ["root"], "node", "chars", max_functions, max_source_chars))
    kept = judged.where("kept").select("root", "node", "depth", "path")
    ids = kept.select("root", "node")
    inner = calls.join(ids.withColumnRenamed("node", "source_fn"), "source_fn").join(
        ids.withColumnRenamed("node", "target_id"), ["root", "target_id"], "left_semi"
    )
    told = diagnostics.join(ids.withColumnRenamed("node", "function_id"), "function_id")
    return {
        "functions": ids.join(functions.withColumnRenamed("id", "node"), "node"),
        "calls": inner,
        "paths": kept,
        "diagnostics": told,
        "truncation": judged.where("not kept").select("root", "reason").distinct(),
    }


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node of each connected component of the undirected edges (a, b).

    Alternates large and small stars, which end after about log2 of the number of nodes rounds; no component is ever
    gathered, and of a star's edges only the minimum is exchanged. Nodes without edges are their own component.
    """
    links = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b")
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    before = mark(links)
    every = edges.select(F.explode(F.array("a", "b")).alias("node"))
    every = every.unionByName(nodes.select("node")) if nodes is not None else every
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tops, "u")
        again = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(again.unionByName(tops.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links, now = after, mark(after)  # count, sum and exclusive or of two hashes tell whether any link has changed
        if now == before:
            break
        before = now
    label = links.groupBy("u").agg(F.min("v").alias("component"))
    every = every.where("node is not null").distinct()
    return every.join(label, every.node == label.u, "left").select("node", F.coalesce("component", "node").alias("component"))
