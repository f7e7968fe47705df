"""Queries of the general data-pipeline operators: orphan references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.operators.hierarchy import Forest, descendants, forest, paths
from kinweave.operators.references import Parents, References, orphan_references, orphan_report
from kinweave.operators.runtime import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    person, event, batch = (table(spark, d, t) for t in ("person", "person_event", "gedcom_import_batch"))
    return orphan_references(
        [
            References(event, "person_event", "event_id", "related_person_id", "person_id"),
            References(event, "person_event", "event_id", "related_xref", "external_id"),
            References(batch, "gedcom_import_batch", "import_batch_id", "root_external_id", "external_id"),
        ],
        [Parents(person, "person_id", "person_id"), Parents(person, "external_id", "external_id")],
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_id", "field_name")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def _forest(spark: SparkSession, d: str) -> Forest:
    return forest(table(spark, d, "descendant_row"), "person_id", "parent_person_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).nodes.selectExpr("node as person_id", "root as root_person_id", "depth")


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).nodes.selectExpr("node as person_id", "root as root_person_id", "depth", "descendants", "state")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths(_forest(spark, d)).selectExpr("node as person_id", "path")


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_forest(spark, d)).selectExpr("node as person_id", "descendant as descendant_id", "distance")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p7_found, p7_hierarchy, p7_paths, p7_descendants)}

_ORPHANS = """
WITH refs AS (
  SELECT 'person_event' AS table_name, CAST(event_id AS VARCHAR) AS record_id, 'related_person_id' AS field_name, 'person_id' AS kind, lower(trim(tree_id)) AS tree, related_person_id AS ref, created_at FROM person_event
  UNION ALL
  SELECT 'person_event', CAST(event_id AS VARCHAR), 'related_xref', 'external_id', lower(trim(tree_id)), related_xref, created_at FROM person_event
  UNION ALL
  SELECT 'gedcom_import_batch', import_batch_id, 'root_external_id', 'external_id', lower(trim(tree_id)), root_external_id, created_at FROM gedcom_import_batch
), named AS (
  SELECT * EXCLUDE (ref), lower(regexp_replace(ref, '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM refs
), used AS (
  SELECT * FROM named WHERE k IS NOT NULL AND k NOT IN ('', 'void', 'null', 'none', '00000000000000000000000000000000')
), keys AS (
  SELECT 'person_id' AS kind, lower(trim(tree_id)) AS tree, lower(regexp_replace(person_id, '[^\\p{L}\\p{N}]', '', 'g')) AS k, created_at FROM person
  UNION ALL
  SELECT 'external_id', lower(trim(tree_id)), lower(regexp_replace(external_id, '[^\\p{L}\\p{N}]', '', 'g')), created_at FROM person
), known AS (
  SELECT kind, tree, k, min(created_at) AS parent_at FROM keys WHERE k IS NOT NULL AND k <> '' GROUP BY ALL
), orphans AS (
  SELECT table_name, record_id, field_name, min(used.created_at) AS reference_at, max(CASE WHEN known.k IS NULL THEN 'missing' ELSE 'later' END) AS reason
  FROM used LEFT JOIN known USING (kind, tree, k)
  WHERE known.k IS NULL OR used.created_at < known.parent_at
  GROUP BY table_name, record_id, field_name
)
"""

_WALK = """
WITH RECURSIVE pairs AS (
  SELECT nullif(lower(trim(person_id)), '') AS node, nullif(lower(trim(parent_person_id)), '') AS parent FROM descendant_row
), links AS (
  SELECT node, min(parent) AS parent FROM (SELECT * FROM pairs WHERE node IS NOT NULL UNION ALL SELECT parent, NULL FROM pairs WHERE parent IS NOT NULL) GROUP BY node
), walk AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.node, w.root, w.depth + 1, w.path || '>' || l.node FROM walk w JOIN links l ON l.parent = w.node
)
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT table_name, record_id, field_name FROM orphans",
    "p2_report": _ORPHANS + "SELECT table_name, field_name, strftime(reference_at, '%Y-%m') AS period, reason, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p7_found": _WALK + "SELECT l.node AS person_id, coalesce(w.root, '') AS root_person_id, coalesce(w.depth, -1) AS depth FROM links l LEFT JOIN walk w ON w.node = l.node",
    "p7_hierarchy": _WALK.rstrip().removesuffix(")")
    + """), steps AS (
  SELECT unnest(string_split(path, '>')) AS a, node FROM walk
), below AS (
  SELECT a, count(*) - 1 AS n FROM steps GROUP BY a
), bad AS (
  SELECT l.* FROM links l ANTI JOIN walk w ON w.node = l.node
), up AS (
  SELECT node AS start, parent AS cur FROM bad UNION SELECT u.start, b.parent FROM up u JOIN bad b ON b.node = u.cur
)
SELECT l.node AS person_id, coalesce(w.root, '') AS root_person_id, coalesce(w.depth, -1) AS depth, CASE WHEN w.node IS NOT NULL THEN coalesce(n, 0) END AS descendants,
  CASE WHEN w.node IS NOT NULL THEN 'tree' WHEN EXISTS (SELECT 1 FROM up WHERE start = l.node AND cur = l.node) THEN 'cycle' ELSE 'below_cycle' END AS state
FROM links l LEFT JOIN walk w ON w.node = l.node LEFT JOIN below b ON b.a = l.node""",
    "p7_paths": _WALK + "SELECT l.node AS person_id, w.path FROM links l LEFT JOIN walk w ON w.node = l.node",
    "p7_descendants": _WALK
    + "SELECT a AS person_id, node AS descendant_id, CAST(depth - level AS INTEGER) AS distance FROM (SELECT node, depth, unnest(string_split(path, '>')) AS a, generate_subscripts(string_split(path, '>'), 1) - 1 AS level FROM walk) WHERE a <> node",
}
