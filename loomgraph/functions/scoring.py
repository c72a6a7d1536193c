"""Scores on columns: cosine, reciprocal ranks, expansion, audio levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the retrieval steps.
RRF_K, HYBRID_K = 60, 50
VECTOR_K, RERANK_K, SEEDS, EXPANDED = 30, 20, 10, 15
EDGE_WEIGHT, CHUNK_SIMILARITY, QUESTION_SIMILARITY, PATH_SCORE, NEIGHBOURS = 0.3, 0.72, 0.8, 0.2, 10
BM25_K1, BM25_B = 1.2, 0.75


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 when a norm is 0; null when the lengths differ or a value is null."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def reciprocal_rank(rank: Column, weight: float, k: int = RRF_K) -> Column:
    """weight / (k + rank); an absent side gives 0."""
    return F.coalesce(F.lit(float(weight)) / (F.lit(k) + rank), F.lit(0.0))


def bm25_term(tf: Column, length: Column, mean_length: Column, n: Column, df: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def planner_action(skill: Column) -> Column:
    return F.when(skill.isin("hint", "explanation"), "GENERATE").when(skill == "ask", "ASK_QUESTION").otherwise("EVALUATE")
