"""Relational queries on small tables of their own."""

from datetime import datetime

from impactframe.plans.relations import QUERIES

SCHEMA = "root_id bigint, snapshot_no int, path string, sha256 string, file_exists boolean, delivered_at timestamp"


def test_compare_snapshots_takes_every_delivered_snapshot(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [
        (1, 2, "a", "h1", True, at), (1, 2, "b", "h1", True, at), (1, 5, "a", "h2", True, at), (1, 5, "c", None, True, at),
        (1, 9, "a", "h2", True, at), (1, 9, "c", None, False, at), (2, 2, "z", "h", True, at), (3, 4, "q", "h", True, at), (3, 5, "q", "h", False, at),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/file_state.parquet")
    got = {tuple(r) for r in QUERIES["joi1_compare_snapshots"](spark, str(tmp_path)).collect()}
    assert got == {(1, 5, "a", "modified"), (1, 5, "b", "deleted"), (1, 5, "c", "added"), (1, 9, "c", "deleted"), (3, 5, "q", "deleted")}
