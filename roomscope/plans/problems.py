"""Queries of the two general problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import references as rf
from ..sources.tables import table


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    jp, rc, tc = (table(spark, root, t) for t in ("job_photos", "room_clusters", "timeline_clips"))
    keys = {"photos": rf.uuid_key, "job_photos": rf.number_key, "clips": rf.number_key}
    refs = [
        rf.references(jp, "job_photos", "photos", "id", "rails_photo_id", "loaded_at", rf.uuid_key),
        rf.references(rc, "room_clusters", "job_photos", "id", "hero_photo_id", "loaded_at", rf.number_key),
        rf.references(tc, "timeline_clips", "clips", "id", "clip_id", "loaded_at", rf.number_key),
    ]
    parents = [rf.parent_rows(table(spark, root, p), p, "id", "loaded_at", k) for p, k in keys.items()]
    parents.append(rf.log_rows(table(spark, root, "deletion_log"), "table_name", "record_key", "action", "logged_at", "log_id", keys))
    return rf.find_orphans(refs, parents)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("table_name", "record_id", "period").distinct()


def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    return rf.orphan_counts(_orphans(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows = iv.intervals(table(spark, root, "timeline_clips"), "id", "timeline_id", "in_time", "out_time")
    return iv.merged_and_gaps(rows).withColumnRenamed("entity", "timeline_id")


def p2_periods(spark: SparkSession, root: str) -> DataFrame:
    rows = iv.intervals(table(spark, root, "timeline_clips"), "id", "timeline_id", "in_time", "out_time")
    return iv.periods(rows).withColumnRenamed("entity", "timeline_id")


_P1 = r"""
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'job_photos' AS table_name, 'photos' AS parent, id AS record_id, lower(regexp_replace(rails_photo_id, '[^\p{L}\p{N}]', '', 'g')) AS k, loaded_at
    FROM job_photos WHERE NOT regexp_full_match(rails_photo_id, '[\s\p{Z}]*')
    UNION ALL SELECT 'room_clusters', 'job_photos', id, CAST(hero_photo_id AS VARCHAR), loaded_at FROM room_clusters WHERE hero_photo_id IS NOT NULL
    UNION ALL SELECT 'timeline_clips', 'clips', id, CAST(clip_id AS VARCHAR), loaded_at FROM timeline_clips WHERE clip_id IS NOT NULL)),
parents AS (
  SELECT parent, k, min(loaded_at) AS first_at FROM (
    SELECT 'photos' AS parent, lower(regexp_replace(id, '[^\p{L}\p{N}]', '', 'g')) AS k, loaded_at FROM photos
    UNION ALL SELECT 'job_photos', CAST(id AS VARCHAR), loaded_at FROM job_photos
    UNION ALL SELECT 'clips', CAST(id AS VARCHAR), loaded_at FROM clips) GROUP BY ALL),
log AS (
  SELECT table_name AS parent, CASE WHEN table_name = 'photos' THEN lower(regexp_replace(record_key, '[^\p{L}\p{N}]', '', 'g')) ELSE trim(record_key) END AS k,
         arg_max(action, (logged_at, log_id)) AS action FROM deletion_log GROUP BY ALL),
found AS (
  SELECT r.table_name, r.record_id, strftime(r.loaded_at, '%Y-%m') AS period, p.k IS NULL AS missing, coalesce(l.action = 'delete', false) AS deleted,
         coalesce(p.first_at > r.loaded_at, false) AS late
  FROM refs r LEFT JOIN parents p USING (parent, k) LEFT JOIN log l USING (parent, k))
"""
_P2 = """
WITH iv AS (
  SELECT DISTINCT id, timeline_id, TRY_CAST(round(in_time * 1000) AS BIGINT) AS s, TRY_CAST(round(out_time * 1000) AS BIGINT) AS e FROM timeline_clips
  WHERE in_time IS NOT NULL AND out_time IS NOT NULL AND NOT isnan(in_time) AND NOT isnan(out_time)),
ok AS (SELECT * FROM iv WHERE e > s),
seen AS (SELECT *, max(e) OVER (PARTITION BY timeline_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
num AS (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY timeline_id ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS no FROM seen),
per AS (SELECT timeline_id, min(s) AS start_ms, max(e) AS end_ms, bool_or(coalesce(before > s, false)) AS overlapping FROM num GROUP BY timeline_id, no)
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_periods": p2_periods}
SQL = {
    "p1_found": _P1 + "SELECT DISTINCT table_name, record_id, period FROM found WHERE missing OR deleted OR late",
    "p1_counts": _P1 + """SELECT table_name, period, count(*) AS orphans, count(*) FILTER (missing) AS missing, count(*) FILTER (deleted) AS deleted,
      count(*) FILTER (late) AS late FROM found WHERE missing OR deleted OR late GROUP BY ALL""",
    "p2_found": _P2 + """SELECT timeline_id, 'merged' AS kind, start_ms, end_ms FROM per WHERE overlapping UNION ALL
      SELECT * FROM (SELECT timeline_id, 'gap' AS kind, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY timeline_id ORDER BY start_ms) AS end_ms FROM per) WHERE end_ms IS NOT NULL""",
    "p2_periods": _P2 + "SELECT timeline_id, start_ms, end_ms, overlapping FROM per",
}
