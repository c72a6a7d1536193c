"""Clean inputs shared by the queries, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.tables import load

DIM = 64


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, each id once; damaged vectors are null."""
    c = load(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    v = F.col("embeddings")
    good = (F.size(v) == DIM) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return c.withColumn("embeddings", F.when(good, v))


def entity_edges(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "entity_edges").dropDuplicates(["edge_id"])


def chunk_edges(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "chunk_edges").dropDuplicates(["edge_id"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").dropDuplicates(["doc_id"])


C = """c AS (SELECT chunk_id, document_id, source_id, text, entities, created_at,
  CASE WHEN len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 THEN embeddings END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS n FROM chunks) WHERE n = 1)"""
E = "e AS (SELECT DISTINCT * FROM entity_edges)"
CE = "ce AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id) AS n FROM chunk_edges) WHERE n = 1)"
D = "d AS (SELECT DISTINCT * FROM documents)"
TOK = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
UNDIRECTED = """u AS (SELECT a, b, weight, semantic FROM (
    SELECT least(source, target) AS a, greatest(source, target) AS b, weight, coalesce(edge_type = 'semantic', false) AS semantic,
      row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY weight DESC, coalesce(edge_type = 'semantic', false) DESC) AS n
    FROM entity_edges WHERE source <> target AND trim(source, ' ') <> '' AND trim(target, ' ') <> '' AND weight BETWEEN 0 AND 1 AND NOT isnan(weight)) WHERE n = 1),
  s AS (SELECT a AS node, b AS neighbour, weight, semantic FROM u UNION ALL SELECT b, a, weight, semantic FROM u),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbour) AS neighbour_rank FROM s) WHERE neighbour_rank <= {fan})"""


class Catalogue:
    """Collects queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
