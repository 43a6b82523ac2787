"""Snapshot differences against a comparison of sets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from impactframe.operators import snapshots
from impactframe.operators.snapshots import hex_value, posix_path, snapshot_differences

SCHEMA = "root_id bigint, snapshot_no int, path string, file_exists boolean, size_bytes bigint, sha256 string, delivered_at timestamp, idx int, salt string"


def at(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def found(spark, rows):
    return {tuple(r) for r in snapshot_differences(frame(spark, rows)).collect()}


def test_against_sets(spark):
    rng = random.Random(3)
    rows = []
    for root in (1, 2):
        for no in (1, 2, 5, 6, 9):
            for p in "abcdef":
                for _ in range(rng.choice([0, 1, 1, 2])):
                    rows.append((root, no, f"d/{p}", rng.random() < 0.8, 1, rng.choice(["01", "1", "02", "A"]), at(rng.randint(0, 10**6))))
    last = {}
    for r in rows:
        k = (r[0], r[1], r[2])
        if k not in last or r[6] > last[k][6]:
            last[k] = r
    expected = set()
    for root in (1, 2):
        nos = sorted({r[1] for r in rows if r[0] == root})
        state = {no: {k[2]: int(r[5], 16) for k, r in last.items() if k[:2] == (root, no) and r[3]} for no in nos}
        for a, b in zip(nos, nos[1:]):
            for p in state[a].keys() | state[b].keys():
                if p not in state[a]:
                    expected.add((root, b, p, "added"))
                elif p not in state[b]:
                    expected.add((root, b, p, "deleted"))
                elif state[a][p] != state[b][p]:
                    expected.add((root, b, p, "modified"))
    assert found(spark, rows) == expected


def test_paths_and_hashes_written_alike(spark):
    rows = [
        (1, 1, "./a\\b//c.py", True, 1, "0xAB", at(1)), (1, 2, "a/b/c.py", True, 2, "00ab", at(2)),
        (1, 1, "x/../y", True, 1, "1", at(1)), (1, 2, "y", True, 1, "2", at(2)), (1, 2, "Y", True, 1, "2", at(2)),
    ]
    assert found(spark, rows) == {(1, 2, "y", "modified"), (1, 2, "Y", "added")}


def test_nulls_ties_and_empty(spark):
    rows = [
        (1, 1, "a", None, None, "1", at(1)), (1, 2, "a", True, None, None, at(2)), (1, 3, "a", True, None, None, None),
        (1, 4, "a", True, None, "5", at(3)), (1, 4, "a", True, None, "5", at(3)), (None, 1, "a", True, 1, "1", at(1)),
        (1, None, "a", True, 1, "1", at(1)), (1, 1, None, True, 1, "1", at(1)), (1, 5, "b" * 5000, True, 1, "", at(1)),
    ]
    assert found(spark, rows) == {(1, 2, "a", "added"), (1, 4, "a", "modified"), (1, 5, "a", "deleted"), (1, 5, "b" * 5000, "added")}
    assert found(spark, []) == set()


def test_a_snapshot_without_present_files_still_counts(spark):
    rows = [(1, 1, "a", True, 1, "1", at(1)), (1, 2, "a", False, None, None, at(2)), (1, 3, "a", True, 1, "1", at(3))]
    assert found(spark, rows) == {(1, 2, "a", "deleted"), (1, 3, "a", "added")}


def test_expressions(spark):
    df = spark.createDataFrame([("/a/./b/", " 0X0F "), ("", ""), (None, None)], "p string, h string")
    rows = df.select(posix_path(F.col("p")), hex_value(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("a/b", "f"), ("", ""), (None, None)]


def test_a_long_snapshot_list_is_joined_salted(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1 + k % 3, no, f"p{k}", rng.random() < 0.8, 1, rng.choice("abc"), at(no)) for k in range(40) for no in (2, 3, 7)]
    whole = found(spark, rows)
    monkeypatch.setattr(snapshots, "LISTED", 0)
    assert whole and found(spark, rows) == whole


def test_hashes_compare_as_numbers_and_keep_their_order(spark):
    texts = ["ab", "0xAB", " 00ab", "abc", "abc0", "0", "000", "no hex", "NO HEX", "", None, "f" * 64, "0" + "f" * 64]
    rows = spark.createDataFrame([(t,) for t in texts], "h string").select("h", hex_value(F.col("h")).alias("v"), snapshots.packed_hash(F.col("h")).alias("p")).collect()
    for a in rows:
        for b in rows:
            assert (a.v == b.v) == (a.p == b.p), (a.h, b.h)
            if a.v and b.v and all(set(x.v) <= set("0123456789abcdef") for x in (a, b)):
                assert (a.v < b.v) == ((bytes(a.p.bytes), a.p.digits) < (bytes(b.p.bytes), b.p.digits))
