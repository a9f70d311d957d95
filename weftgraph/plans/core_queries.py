"""Queries of the general operators, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.orphans import orphan_counts, orphan_references
from weftgraph.operators.snapshot_diff import snapshot_changes
from weftgraph.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "entity_snapshots")).select("snapshot_no", "entity_id", "change", "field")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshot_changes(table(spark, d, "entity_snapshots"))
    return changes.groupBy("project_slug", "snapshot_no", "change", "field").agg(F.count("*").alias("n"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references({t: table(spark, d, t) for t in ("sources", "source_spans", "chunks", "entities", "knowledge_chunks")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_id", "ref_id", "state")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_counts": p1_counts, "p6_found": p6_found, "p6_counts": p6_counts}

_P1 = """
WITH latest AS (
  SELECT project_slug, snapshot_no, id, max(struct_pack(a := coalesce(delivered_at, TIMESTAMP '0001-01-01'), d := description, c := community, s := source_path)) AS x
  FROM entity_snapshots WHERE project_slug IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
steps AS (
  SELECT project_slug, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project_slug ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT project_slug, snapshot_no FROM latest)),
old AS (SELECT l.*, n.snapshot_no AS later FROM latest l JOIN steps n ON n.project_slug = l.project_slug AND n.before = l.snapshot_no),
new AS (SELECT l.* FROM latest l JOIN steps s USING (project_slug, snapshot_no) WHERE s.before IS NOT NULL),
pairs AS (
  SELECT coalesce(n.project_slug, o.project_slug) AS project_slug, coalesce(n.snapshot_no, o.later) AS snapshot_no, coalesce(n.id, o.id) AS entity_id,
         n.id AS nid, o.id AS oid, n.x AS nx, o.x AS ox
  FROM new n FULL JOIN old o ON n.project_slug = o.project_slug AND n.snapshot_no = o.later AND n.id = o.id),
changes AS (
  SELECT project_slug, snapshot_no, entity_id, 'added' AS change, '' AS field FROM pairs WHERE oid IS NULL
  UNION ALL SELECT project_slug, snapshot_no, entity_id, 'removed', '' FROM pairs WHERE nid IS NULL
  UNION ALL SELECT project_slug, snapshot_no, entity_id, 'modified', 'description' FROM pairs WHERE oid IS NOT NULL AND nid IS NOT NULL AND nx.d IS DISTINCT FROM ox.d
  UNION ALL SELECT project_slug, snapshot_no, entity_id, 'modified', 'community' FROM pairs WHERE oid IS NOT NULL AND nid IS NOT NULL AND nx.c IS DISTINCT FROM ox.c
  UNION ALL SELECT project_slug, snapshot_no, entity_id, 'modified', 'source_path' FROM pairs WHERE oid IS NOT NULL AND nid IS NOT NULL AND nx.s IS DISTINCT FROM ox.s)
"""

_CLEAN = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_P6 = f"""
WITH refs AS (
  SELECT 'source_spans' AS table_name, 'sources' AS parent, project_slug, id AS record_id, {_CLEAN.format("source_id")} AS ref_id, ingested_at, deleted_at FROM source_spans
  UNION ALL SELECT 'chunks', 'source_spans', project_slug, id, {_CLEAN.format("source_span_id")}, ingested_at, deleted_at FROM chunks
  UNION ALL SELECT 'knowledge_chunks', 'entities', project_slug, id, {_CLEAN.format("entity_id")}, ingested_at, deleted_at FROM knowledge_chunks
  UNION ALL SELECT 'entities', 'source_spans', project_slug, id, {_CLEAN.format("r")}, ingested_at, deleted_at
    FROM (SELECT *, unnest(CASE WHEN len(source_span_ids) > 0 THEN source_span_ids ELSE [NULL] END) AS r FROM entities)),
records AS (
  SELECT table_name, project_slug, record_id, min(ingested_at) AS ingested_at, count(deleted_at) > 0 AS gone
  FROM refs WHERE record_id IS NOT NULL GROUP BY ALL),
live AS (
  SELECT DISTINCT r.table_name, r.parent, r.project_slug, r.record_id, r.ref_id, c.ingested_at
  FROM refs r JOIN records c ON r.table_name = c.table_name AND r.project_slug IS NOT DISTINCT FROM c.project_slug AND r.record_id = c.record_id
  WHERE NOT c.gone AND r.ref_id IS NOT NULL AND r.ref_id <> ''),
parents AS (
  SELECT parent, project_slug, ref_id, min(ingested_at) AS at, count(deleted_at) > 0 AS gone FROM (
    SELECT 'sources' AS parent, project_slug, {_CLEAN.format("id")} AS ref_id, ingested_at, deleted_at FROM sources
    UNION ALL SELECT 'source_spans', project_slug, {_CLEAN.format("id")}, ingested_at, deleted_at FROM source_spans
    UNION ALL SELECT 'entities', project_slug, {_CLEAN.format("id")}, ingested_at, deleted_at FROM entities)
  GROUP BY ALL),
orphans AS (
  SELECT l.*, CASE WHEN p.ref_id IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.at > l.ingested_at THEN 'late' END AS state
  FROM live l LEFT JOIN parents p ON p.parent = l.parent AND p.project_slug = l.project_slug AND p.ref_id = l.ref_id)
"""

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT snapshot_no, entity_id, change, field FROM changes",
    "p1_counts": _P1 + "SELECT project_slug, snapshot_no, change, field, count(*) AS n FROM changes GROUP BY ALL",
    "p6_found": _P6 + "SELECT table_name, record_id, ref_id, state FROM orphans WHERE state IS NOT NULL",
    "p6_counts": _P6 + "SELECT table_name, coalesce(strftime(ingested_at, '%Y-%m'), 'unknown') AS period, state, count(*) AS orphans, count(DISTINCT ref_id) AS distinct_refs FROM orphans WHERE state IS NOT NULL GROUP BY ALL",
}
