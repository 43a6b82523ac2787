"""Incremental processing against a plain walk of every root's chain."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from impactframe.operators import incremental
from impactframe.operators.incremental import chain_positions, covered_until, mark_of, open_rows, pending_changes

SETS = "change_set_id bigint, root_id bigint, baseline_revision string, working_revision string, landed string"
CHANGES = "change_id bigint, change_set_id bigint, root_id bigint, path string, status string, baseline_sha256 string, working_sha256 string, landed_at timestamp, version string, covered string"
RUNS = "run_id bigint, root_id bigint, status string, baseline_revision string, working_revision string, started_at timestamp, lo string"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def brute(sets, changes, runs):
    up = {(s[1], s[3]): s[2] for s in sets}

    def chain(root, revision):
        out = []
        while revision != "initial" and (root, revision) in up and len(out) <= len(up):
            out.append(revision)
            revision = up[root, revision]
        return out if revision == "initial" else None

    landed = {}
    for c in changes:
        if c[0] is not None:
            key = (c[0], c[1:7])
            landed[key] = min((x for x in (landed.get(key), c[7]) if x is not None), default=None)
    latest = {}
    for (cid, content), at in landed.items():
        if cid not in latest or (at is not None and (latest[cid][1] is None or at > latest[cid][1])):
            latest[cid] = (content, at)
    out = set()
    for cid, ((cs, root, *_), at) in latest.items():
        mine = [s[3] for s in sets if s[0] == cs and s[1] == root]
        done = False
        for r in runs:
            if at is None or r[2] != "succeeded" or r[1] != root or r[5] is None or r[5] < at:
                continue
            high, low = chain(root, r[4]), [] if r[3] == "initial" else chain(root, r[3])
            done |= high is not None and low is not None and any(m in high and m not in low for m in mine)
        if not done:
            out.add((root, cid))
    return out


def run(spark, sets, changes, runs):
    s = spark.createDataFrame([(*x, "x") for x in sets], SETS)
    c = spark.createDataFrame([(*x, "v", "c") for x in changes], CHANGES)
    r = spark.createDataFrame([(*x, "l") for x in runs], RUNS)
    return {(x.root_id, x.change_id) for x in pending_changes(s, c, r).collect()}


def history(rng):
    sets, changes, runs, cid = [], [], [], 0
    for root in range(1, 7):
        revs = ["initial", *(f"r{root}_{k}" for k in range(rng.randint(1, 11)))]
        for k in range(1, len(revs)):
            sets.append((root * 100 + k, root, revs[k - 1], revs[k]))
            for _ in range(rng.randint(0, 3)):
                cid += 1
                row = (cid, root * 100 + k, root, f"p{cid}", "modified", "a", "b", day(10 * k + rng.randint(0, 3)))
                changes += [row] * rng.randint(1, 2)
                if rng.random() < 0.3:
                    changes.append((*row[:6], "c", day(10 * k + rng.randint(1, 40))))
        for n in range(rng.randint(0, 4)):
            a, b = sorted(rng.sample(range(len(revs)), 2)) if len(revs) > 1 else (0, 0)
            status = rng.choice(["succeeded", "succeeded", "failed", "undone", None])
            runs += [(root * 10 + n, root, status, revs[a], revs[b], day(10 * b + rng.randint(0, 30)))] * rng.randint(1, 2)
    return sets + sets[:3], changes, runs


@pytest.mark.parametrize("seed", [5, 6])
def test_against_walk(spark, seed):
    rng = random.Random(seed)
    sets, changes, runs = history(rng)
    changes += [(*c[:7], None) for c in rng.sample(changes, 3)] + [(1_000 + k, *c[1:7], None) for k, c in enumerate(rng.sample(changes, 3))]
    assert run(spark, sets, changes, runs) == brute(sets, changes, runs)


def test_marks_reread_less_and_skip_nothing(spark, tmp_path):
    """Every root's runs go on after the first call: with its mark fewer rows are read, and the same changes are pending."""
    sets, changes, runs = history(random.Random(11))
    last = {root: max(s for s in sets if s[1] == root) for root in {s[1] for s in sets}}
    early = [c for c in changes if c[7] <= day(70)]
    first = [(900 + root, root, "succeeded", "initial", s[3], day(71)) for root, s in last.items()]
    frames = lambda c, r: (
        spark.createDataFrame([(*x, "x") for x in sets], SETS), spark.createDataFrame([(*x, "v", "c") for x in c], CHANGES).repartition(1),
        spark.createDataFrame([(*x, "l") for x in r], RUNS),
    )
    s, c, r = frames(early, first)
    assert pending_changes(s, c, r).count() == 0
    mark_of(pending_changes(s, c, r), c, r).write.parquet(f"{tmp_path}/mark")
    mark = spark.read.parquet(f"{tmp_path}/mark")
    s, c, r = frames(changes, first + runs)
    c.write.parquet(f"{tmp_path}/changes")
    c = spark.read.parquet(f"{tmp_path}/changes")
    found = lambda m, runs=r: {(x.root_id, x.change_id) for x in pending_changes(s, c, runs, m).collect()}
    assert found(mark) == found(None) == brute(sets, changes, first + runs)
    cover = covered_until(s, chain_positions(s), r)
    since = mark.select(F.unix_micros("floor")).first()[0]
    plan = open_rows(c, cover, since)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(landed_at" in plan and "path" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert 0 < c.where(F.col("landed_at") >= F.timestamp_micros(F.lit(since))).count() < c.count() / 2
    # a withdrawn run voids the mark
    gone = spark.createDataFrame([(*x[:2], "undone", *x[3:], "l") for x in first], RUNS)
    assert found(mark, gone) == brute(sets, changes, [(*x[:2], "undone", *x[3:]) for x in first])


def test_nulls_cycles_and_empty_tables(spark):
    sets = [(1, 1, "initial", "a"), (2, 1, "x", "y"), (3, 1, "y", "x"), (4, None, "initial", "q"), (5, 1, None, "z"), (6, 1, "a", None)]
    changes = [
        (1, 1, 1, "p", "added", None, "h", day(1)), (2, 2, 1, "p", "added", None, "h", day(1)), (None, 1, 1, "p", "added", None, "h", day(1)),
        (3, 1, 1, "p", "added", None, "h", None), (4, 4, None, "p", None, None, None, day(1)), (5, None, 1, None, None, None, None, day(1)),
    ]
    runs = [(1, 1, "succeeded", "initial", "a", day(2)), (2, 1, "succeeded", "x", "y", day(3)), (3, 1, "succeeded", None, None, None)]
    assert run(spark, sets, changes, runs) == {(1, 2), (1, 3), (None, 4), (1, 5)}
    assert run(spark, [], changes[:2], []) == {(1, 1), (1, 2)}
    assert run(spark, sets, [], runs) == set()


def test_content_that_lands_after_the_run_is_pending_again(spark):
    row = (1, 1, 1, "p", "modified", "a", "b", day(1))
    sets, runs = [(1, 1, "initial", "a")], [(1, 1, "succeeded", "initial", "a", day(2))]
    assert run(spark, sets, [row, (*row[:6], "c", day(3))], runs) == {(1, 1)}
    assert run(spark, sets, [row, (*row[:7], day(3))], runs) == set()  # the same content again
    assert run(spark, sets, [row], [(*runs[0][:5], day(1))]) == set()  # started at the landing


def test_long_chain_in_logarithmic_rounds(spark):
    sets = [(k, 1, "initial" if k == 0 else f"r{k - 1}", f"r{k}") for k in range(300)]
    found = {r.revision: r.pos for r in chain_positions(spark.createDataFrame([(*s, "") for s in sets], SETS)).collect()}
    assert found == {f"r{k}": k + 1 for k in range(300)}


def test_many_open_changes_are_exchanged_alike(spark, monkeypatch):
    sets, changes, runs = history(random.Random(2))
    monkeypatch.setattr(incremental, "FEW_IDS", 0)
    assert run(spark, sets, changes, runs) == brute(sets, changes, runs)
