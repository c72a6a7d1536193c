"""Queries on references between chunks and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import references as R
from loomgraph.sources.tables import load


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    refs = R.references(load(spark, folder, "entity_edges"), "entity_edges", ["chunk_id"], "edge_id").unionByName(
        R.references(load(spark, folder, "chunk_edges"), "chunk_edges", ["source_chunk", "target_chunk"], "edge_id")
    )
    parents = R.parent_validity(load(spark, folder, "chunks"), "chunk_id", load(spark, folder, "chunk_deletions"))
    return R.orphan_references(refs, parents)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "ref_column", "edge_id", "kind").distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, folder))


_SQL = """
WITH refs AS (
  SELECT DISTINCT 'entity_edges' AS ref_table, 'chunk_id' AS ref_column, edge_id, lower(trim(chunk_id, ' ')) AS k, created_at FROM entity_edges
  UNION SELECT 'chunk_edges', 'source_chunk', edge_id, lower(trim(source_chunk, ' ')), created_at FROM chunk_edges
  UNION SELECT 'chunk_edges', 'target_chunk', edge_id, lower(trim(target_chunk, ' ')), created_at FROM chunk_edges),
born AS (SELECT lower(trim(chunk_id, ' ')) AS k, max(created_at) AS parent_at FROM chunks GROUP BY 1),
died AS (SELECT DISTINCT lower(trim(chunk_id, ' ')) AS k, deleted_at, restored_at FROM chunk_deletions),
judged AS (
  SELECT r.*, CASE
    WHEN b.k IS NULL THEN 'missing'
    WHEN EXISTS (SELECT 1 FROM died d WHERE d.k = r.k AND d.deleted_at <= r.created_at AND (d.restored_at IS NULL OR d.restored_at > r.created_at)) THEN 'deleted'
    WHEN b.parent_at > r.created_at THEN 'late' END AS kind
  FROM refs r LEFT JOIN born b ON b.k = r.k WHERE r.k <> '')
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _SQL + "SELECT DISTINCT ref_table, ref_column, edge_id, kind FROM judged WHERE kind IS NOT NULL",
    "p4_report": _SQL + "SELECT ref_table, ref_column, kind, strftime(created_at, '%Y-%m') AS month, count(*) AS orphans FROM (SELECT DISTINCT ref_table, ref_column, edge_id, created_at, kind FROM judged WHERE kind IS NOT NULL) GROUP BY ALL",
}
