"""Queries over the snapshot tables and their SQL."""

from __future__ import annotations

from hearthdex.operators.snapshot_diff import snapshot_changes
from hearthdex.session import table


def p3_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "file_states"), table(spark, sf_dir, "snapshots"))


P3_SQL = r"""
WITH pairs AS (
  SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev_no
  FROM (SELECT DISTINCT repo, snapshot_no FROM snapshots WHERE status = 'complete')
), clean AS (
  SELECT repo, snapshot_no,
         array_to_string(list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path,
         regexp_replace(lower(trim(hash)), '^[a-z0-9_-]+[:=]|^0x', '') AS digest, loaded_at
  FROM file_states
), latest AS (
  SELECT repo, snapshot_no, path, digest FROM clean
  QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, path ORDER BY loaded_at DESC NULLS LAST, digest DESC NULLS LAST) = 1
), present AS (
  SELECT * FROM latest WHERE digest IS NOT NULL
), sided AS (
  SELECT p.repo, p.snapshot_no, s.path, s.digest AS now, NULL AS before
  FROM pairs p JOIN present s ON s.repo = p.repo AND s.snapshot_no = p.snapshot_no WHERE p.prev_no IS NOT NULL
  UNION ALL
  SELECT p.repo, p.snapshot_no, s.path, NULL, s.digest
  FROM pairs p JOIN present s ON s.repo = p.repo AND s.snapshot_no = p.prev_no
), joined AS (
  SELECT repo, snapshot_no, path, max(now) AS now, max(before) AS before FROM sided GROUP BY ALL
)
SELECT repo, snapshot_no, path,
       CASE WHEN before IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM joined WHERE now IS DISTINCT FROM before
"""

QUERIES = {"p3_found": p3_found}
SQL = {"p3_found": P3_SQL}
