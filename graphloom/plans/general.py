"""Queries p2 and p4 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import descendants, hierarchy
from graphloom.operators.references import orphan_counts, orphan_references, parent_spans, references


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.read.parquet(f"{d}/edges.parquet").select("id", "from", "to", "ingested_at")
    nodes = spark.read.parquet(f"{d}/nodes.parquet").select("id", "ingested_at", "deleted_at")
    return orphan_references(references(edges), parent_spans(nodes))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("ref_id").alias("edge_id"), "endpoint").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


def _tree(spark: SparkSession, d: str, paths: bool) -> DataFrame:
    return hierarchy(spark.read.parquet(f"{d}/concepts.parquet").select("session_id", "type", "parent"), paths=paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, False)


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, True).withColumn("path", F.array_join("path", " > "))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_tree(spark, d, True))


_MISSES = """WITH refs AS (
  SELECT 'edges' AS "table", 'from' AS endpoint, id, "from" AS key, ingested_at AS seen FROM edges WHERE "from" IS NOT NULL
  UNION ALL SELECT 'edges', 'to', id, "to", ingested_at FROM edges WHERE "to" IS NOT NULL),
misses AS (SELECT * FROM refs r WHERE NOT EXISTS (
  SELECT 1 FROM nodes n WHERE n.id = r.key AND n.ingested_at <= r.seen AND (n.deleted_at IS NULL OR n.deleted_at > r.seen)))
"""

_TREE = r"""WITH RECURSIVE one AS (
  SELECT DISTINCT session_id, type, lower(regexp_replace(type, '^\s+|\s+$', '', 'g')) AS k, nullif(lower(regexp_replace(parent, '^\s+|\s+$', '', 'g')), '') AS p FROM concepts),
tree(session_id, type, k, root, depth, path) AS (
  SELECT session_id, type, k, type, 0, type FROM one a WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM one b WHERE b.session_id = a.session_id AND b.k = a.p)
  UNION ALL
  SELECT c.session_id, c.type, c.k, t.root, t.depth + 1, t.path || ' > ' || c.type FROM one c JOIN tree t ON c.session_id = t.session_id AND c.p = t.k)
"""

_REST = "SELECT session_id, type, '(cycle)', -1{} FROM one a WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.session_id = a.session_id AND t.type = a.type)"

QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p4_paths, p4_descendants)}

SQL = {
    "p2_found": _MISSES + "SELECT DISTINCT id AS edge_id, endpoint FROM misses",
    "p2_report": _MISSES + """SELECT "table", endpoint, month, count(*) AS "references", count(DISTINCT key) AS keys
FROM (SELECT DISTINCT "table", endpoint, strftime(seen, '%Y-%m') AS month, key, id FROM misses) GROUP BY 1, 2, 3""",
    "p4_found": _TREE + "SELECT session_id, type, root, CAST(depth AS INTEGER) AS depth FROM tree UNION ALL " + _REST.format(""),
    "p4_paths": _TREE + "SELECT session_id, type, root, CAST(depth AS INTEGER) AS depth, path FROM tree UNION ALL " + _REST.format(", NULL"),
    "p4_descendants": _TREE.replace("path) AS", "up) AS").replace("0, type FROM one a", "0, [type] FROM one a").replace("t.path || ' > ' || c.type", "list_append(t.up, c.type)")
    + "SELECT session_id, unnest(up) AS ancestor, type AS descendant, CAST(depth - generate_subscripts(up, 1) + 1 AS INTEGER) AS distance FROM tree",
}
