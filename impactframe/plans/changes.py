"""Queries of the general problems 2 and 3, each beside the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.operators.incremental import chain_positions, pending_changes
from impactframe.operators.snapshots import snapshot_differences
from impactframe.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    sets, changes, runs = (table(spark, sf, t) for t in ("change_set", "file_change", "doc_run"))
    return pending_changes(sets, changes, runs).select("root_id", "change_id").distinct()


def p2_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chain_positions(table(spark, sf, "change_set"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_differences(table(spark, sf, "file_state"))


def p3_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = snapshot_differences(table(spark, sf, "file_state"))
    return found.groupBy("root_id", "snapshot_no", "status").agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p2_chain": p2_chain, "p3_found": p3_found, "p3_summary": p3_summary}

_CHAIN = """
chain AS (
  SELECT DISTINCT root_id, working_revision AS revision, 1::BIGINT AS pos FROM change_set WHERE baseline_revision = 'initial'
  UNION
  SELECT s.root_id, s.working_revision, c.pos + 1 FROM change_set s
  JOIN chain c ON c.root_id = s.root_id AND c.revision = s.baseline_revision
)"""
_DIFF = r"""
rows_ AS (
  SELECT root_id, snapshot_no, delivered_at, coalesce(file_exists, false) AS here,
         ltrim(lower(trim(sha256)), '0') AS hash,
         array_to_string(list_filter(string_split(replace(path, '\', '/'), '/'), lambda p: p <> '' AND p <> '.'), '/') AS path
  FROM file_state),
states AS (
  SELECT * FROM rows_ QUALIFY row_number() OVER (
    PARTITION BY root_id, snapshot_no, path ORDER BY delivered_at DESC NULLS LAST, here DESC, hash DESC NULLS LAST) = 1),
snaps AS (
  SELECT root_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY root_id ORDER BY snapshot_no) AS prev
  FROM (SELECT DISTINCT root_id, snapshot_no FROM file_state)),
present AS (SELECT * FROM states WHERE here),
diff AS (
  SELECT n.root_id, n.snapshot_no, n.path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'modified' END AS status
  FROM present n JOIN snaps s ON s.root_id = n.root_id AND s.snapshot_no = n.snapshot_no AND s.prev IS NOT NULL
  LEFT JOIN present o ON o.root_id = n.root_id AND o.snapshot_no = s.prev AND o.path = n.path
  WHERE o.path IS NULL OR o.hash IS DISTINCT FROM n.hash
  UNION ALL
  SELECT o.root_id, s.snapshot_no, o.path, 'deleted'
  FROM present o JOIN snaps s ON s.root_id = o.root_id AND s.prev = o.snapshot_no
  WHERE NOT EXISTS (SELECT 1 FROM present n WHERE n.root_id = o.root_id AND n.snapshot_no = s.snapshot_no AND n.path = o.path))"""

SQL = {
    "p2_chain": f"WITH RECURSIVE {_CHAIN} SELECT root_id, revision, pos FROM chain",
    "p2_found": f"""
WITH RECURSIVE {_CHAIN},
landings AS (
  SELECT change_id, change_set_id, path, status, baseline_sha256, working_sha256, min(root_id) AS root_id,
         min(landed_at) AS landed FROM file_change GROUP BY ALL),
latest AS (SELECT * FROM landings QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY landed DESC) = 1),
runs AS (
  SELECT r.root_id, r.started_at, CASE WHEN r.baseline_revision = 'initial' THEN 0 ELSE b.pos END AS lo, w.pos AS hi
  FROM doc_run r JOIN chain w ON w.root_id = r.root_id AND w.revision = r.working_revision
  LEFT JOIN chain b ON b.root_id = r.root_id AND b.revision = r.baseline_revision
  WHERE r.status = 'succeeded')
SELECT DISTINCT l.root_id, l.change_id FROM latest l
WHERE NOT EXISTS (
  SELECT 1 FROM change_set s JOIN chain c ON c.root_id = s.root_id AND c.revision = s.working_revision
  JOIN runs r ON r.root_id = s.root_id AND c.pos > r.lo AND c.pos <= r.hi
  WHERE s.change_set_id = l.change_set_id AND s.root_id = l.root_id AND r.started_at >= l.landed)""",
    "p3_found": f"WITH {_DIFF} SELECT root_id, snapshot_no, path, status FROM diff",
    "p3_summary": f"WITH {_DIFF} SELECT root_id, snapshot_no, status, count(*) AS n FROM diff GROUP BY ALL",
}
