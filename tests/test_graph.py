"""Graph operators against plain searches."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from impactframe.operators.graph import closure, components, dependency_context, neighbours, reachable, within_budget
from impactframe.operators.ordering import running


def bfs(edges, root, limit=None):
    out, todo = {root: (root,)}, deque([root])
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    while todo:
        n = todo.popleft()
        if limit is not None and len(out[n]) > limit:
            continue
        for m in sorted(after.get(n, ())):
            if m not in out:
                out[m] = (*out[n], m)
                todo.append(m)
    return out


@pytest.mark.parametrize("limit", [None, 2])
def test_closure_matches_search(spark, limit):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(25)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(45)] * 2 + [("a", "b"), ("b", "a"), ("c", "c")]
    roots = [*names[:6], "a", "c", "alone"]
    df = closure(spark.createDataFrame([*edges, (None, "a")], "src string, dst string"), spark.createDataFrame([(r,) for r in roots] * 2, "root string"), limit)
    got = {(r.root, r.node): tuple(r.path) for r in df.collect()}
    assert got == {(r, n): p for r in roots for n, p in bfs(edges, r, limit).items()}


def test_order_is_that_of_the_walk(spark):
    edges = [("s", "b"), ("s", "a"), ("a", "z"), ("b", "c"), ("z", "s")]
    df = reachable(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("s",)], "root string"))
    assert [r.node for r in sorted(df.collect(), key=lambda r: r.ord)] == ["a", "b", "z", "c"]


def test_neighbours(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("c", "a")], "src string, dst string")
    n = spark.createDataFrame([("a",)], "node string")
    assert [(r.node, r.other) for r in neighbours(e, n).collect()] == [("a", "b")]
    assert [(r.node, r.other) for r in neighbours(e, n, reverse=True).collect()] == [("a", "c")]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)]
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    df = components(spark.createDataFrame([*pairs, (None, 1)], "a int, b int"), spark.createDataFrame([(999,)], "node int"))
    got = {r.node: r.component for r in df.collect()}
    assert got == {**{n: label[n] for n in label if n is not None}, 1: label.get(1, 1), 999: 999}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_budgets_and_context(spark):
    f = spark.createDataFrame([("a", "xx"), ("b", "xxx"), ("c", "x"), ("d", "x")], "id string, source string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    calls = spark.createDataFrame([("a", "b", "b", 1), ("b", "c", "c", 2)], "source_fn string, target_id string, name string, line int")
    told = spark.createDataFrame([("a", "x"), ("d", "y")], "function_id string, code string")
    roots = spark.createDataFrame([("a",)], "root string")
    out = dependency_context(f, e, calls, told, roots, max_functions=3, max_source_chars=5)
    assert {r.node for r in out["functions"].collect()} == {"a", "b"}
    assert {r.reason for r in out["truncation"].collect()} == {"max_functions", "max_source_chars"}
    assert [r.name for r in out["calls"].collect()] == ["b"]
    assert [r.code for r in out["diagnostics"].collect()] == ["x"]
    deep = dependency_context(f, e, calls, told, roots, max_depth=1)
    assert {r.node for r in deep["paths"].collect()} == {"a", "b"} and deep["truncation"].count() == 0
    for bad in ({"max_functions": 0}, {"max_source_chars": -1}, {"max_depth": -1}):
        with pytest.raises(ValueError):
            dependency_context(f, e, calls, told, roots, **bad)
    kept = within_budget(f, [], "id", None, 2, None).where("kept").collect()
    assert [r.id for r in kept] == ["a", "b"]


def test_running_numbers_and_sums_spread_over_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(0, 9), "clash") for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, s int, _r string").drop("_r").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.o): (r.ord, r.total) for r in running(df, ["k"], F.col("o"), "s").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for key in ("hot", "a", None):
        total = 0
        for n, (_, o, s, _) in enumerate(sorted(r for r in rows if r[0] == key) if key else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]), 1):
            total += s
            want[key, o] = (n, total)
    assert got == want
    assert running(df.limit(0), ["k"], F.col("o")).count() == 0
