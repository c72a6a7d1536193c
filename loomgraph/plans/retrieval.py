"""Hybrid retrieval: vector and lexical hits, fusion, reranking, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scoring as S
from loomgraph.functions.text import lowered_tokens
from loomgraph.operators import edges as G
from loomgraph.operators import search as Q
from loomgraph.plans import common as K
from loomgraph.runtime import materialize
from loomgraph.sources.tables import load

query = K.Catalogue()
QUERIES, SQL = query.queries, query.sql


@query(
    """SELECT query_id, item_id, vector_score, vector_rank FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS vector_score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) DESC, i.vec_id) AS vector_rank
  FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0) WHERE vector_rank <= 30"""
)
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 50, against all."""
    e = load(spark, folder, "embeddings").dropDuplicates(["vec_id"])
    return Q.vector_topk(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")))


def _topics(spark: SparkSession, folder: str) -> DataFrame:
    """A query per topic: its name and tags; its scope are the topic's chunks."""
    t = load(spark, folder, "topics").distinct()
    return t.select(F.col("id").alias("query_id"), F.col("id").alias("scope"), F.concat_ws(" ", "name", "tags").alias("query"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return K.chunks(spark, folder).select(F.col("chunk_id").alias("item_id"), F.col("document_id").alias("scope"), "text", "entities", F.col("embeddings").alias("v"))


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    """The postings of all chunks, as a table."""
    fields = {"text": F.col("text"), "entities": F.array_join("entities.normalized_text", " ")}
    return materialize(Q.postings(_items(spark, folder), {n: lowered_tokens(c) for n, c in fields.items()}))


def _vector(spark: SparkSession, folder: str) -> DataFrame:
    """The topic's vector is that of its first chunk with a usable one."""
    items = _items(spark, folder).where("v is not null").select("item_id", "v", "scope")
    first = items.groupBy("scope").agg(F.min_by("v", "item_id").alias("v"))
    queries = _topics(spark, folder).select("query_id", "scope").join(first, "scope").select("query_id", "v", "scope")
    return Q.vector_topk(queries, items, scope=True)


def _fused(spark: SparkSession, folder: str, post: DataFrame, **kw) -> DataFrame:
    return Q.fuse(_vector(spark, folder), Q.lexical_topk(_topics(spark, folder), post), **kw)


def _reranked(spark: SparkSession, folder: str) -> DataFrame:
    """Fused hits are a table as well, since three branches of what follows read them."""
    post = _postings(spark, folder)
    n = load(spark, folder, "chunks").select("chunk_id").distinct().count()
    return materialize(Q.rerank_indexed(_fused(spark, folder, post).select("query_id", "item_id"), _topics(spark, folder), post, n))


_BM25 = f"""WITH {K.C}, t AS (SELECT DISTINCT id AS query_id, concat_ws(' ', name, list_aggregate(tags, 'string_agg', ' ')) AS query FROM topics),
docs AS (SELECT document_id AS scope, chunk_id AS item_id, 'text' AS field, {K.TOK.format("text")} AS w FROM c WHERE text IS NOT NULL
  UNION ALL SELECT document_id, chunk_id, 'entities', {K.TOK.format("list_aggregate(list_transform(entities, lambda e: e.normalized_text), 'string_agg', ' ')")} FROM c WHERE entities IS NOT NULL),
post AS (SELECT scope, item_id, field, len(w) AS length, unnest(w) AS term FROM docs WHERE len(w) > 0),
tf AS (SELECT scope, item_id, field, length, term, count(*) AS tf FROM post GROUP BY ALL),
st AS (SELECT scope, field, count(*) AS n, avg(length) AS ml FROM (SELECT DISTINCT scope, item_id, field, length FROM tf) GROUP BY ALL),
df AS (SELECT scope, field, term, count(*) AS df FROM tf GROUP BY ALL),
terms AS (SELECT DISTINCT query_id, unnest({K.TOK.format("query")}) AS term FROM t),
bs AS (SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ml))), 6) AS bm25_score
  FROM terms JOIN tf ON tf.scope = query_id AND tf.term = terms.term JOIN df ON df.scope = tf.scope AND df.field = tf.field AND df.term = tf.term JOIN st ON st.scope = tf.scope AND st.field = tf.field GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, item_id) AS bm25_rank FROM bs) WHERE bm25_rank <= 30),
qv AS (SELECT document_id AS query_id, arg_min(v, chunk_id) AS v FROM c WHERE v IS NOT NULL AND document_id IN (SELECT query_id FROM t) GROUP BY 1),
vs AS (SELECT query_id, chunk_id AS item_id, round(list_cosine_similarity(qv.v, c.v), 6) AS vector_score FROM qv JOIN c ON c.document_id = query_id WHERE c.v IS NOT NULL),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, item_id) AS vector_rank FROM vs) WHERE vector_rank <= 30),
ff AS (SELECT query_id, item_id, vector_score, vector_rank, bm25_score, bm25_rank, round(coalesce(0.5::DOUBLE / (60 + vector_rank), 0) + coalesce(0.5::DOUBLE / (60 + bm25_rank), 0), 9) AS rrf_score FROM vt FULL JOIN bm USING (query_id, item_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id) AS rrf_rank FROM ff)"""
_RERANK = f""", tx AS (SELECT chunk_id AS item_id, list_distinct({K.TOK.format("text")}) AS tokens FROM c),
nn AS (SELECT count(*) AS n FROM tx),
dfa AS (SELECT term, count(*) AS df FROM (SELECT unnest(tokens) AS term FROM tx) GROUP BY 1),
idf AS (SELECT q.term, CASE WHEN coalesce(df, 0) > 0 THEN ln(1 + n::DOUBLE / df) ELSE 0 END AS idf FROM (SELECT DISTINCT term FROM terms) q LEFT JOIN dfa USING (term), nn),
rs AS (SELECT f.query_id, f.item_id, round(coalesce(sum(CASE WHEN list_contains(tokens, terms.term) THEN idf END) / nullif(sum(idf), 0), 0), 6) AS reranked_score
  FROM fused f JOIN terms USING (query_id) JOIN idf ON idf.term = terms.term LEFT JOIN tx USING (item_id) GROUP BY 1, 2),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranked_score DESC, item_id) AS reranked_rank FROM rs) WHERE reranked_rank <= 20)"""


@query(_BM25 + " SELECT * FROM bm")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return Q.lexical_topk(_topics(spark, folder), _postings(spark, folder))


@query(_BM25 + " SELECT query_id, item_id, coalesce(vector_rank, 0) AS vector_rank, coalesce(bm25_rank, 0) AS bm25_rank, rrf_score, rrf_rank FROM fused")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Rank 0: not among that side's hits."""
    return _fused(spark, folder, _postings(spark, folder)).select("query_id", "item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vector_rank", "bm25_rank")], "rrf_score", "rrf_rank")


@query(_BM25 + ", f50 AS (SELECT query_id, item_id, round(coalesce(0.5::DOUBLE / (50 + vector_rank), 0) + coalesce(0.5::DOUBLE / (50 + bm25_rank), 0), 9) AS rrf_score FROM vt FULL JOIN bm USING (query_id, item_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id) AS rrf_rank FROM f50")
def hybrid_penalty_50(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, _postings(spark, folder), k=S.HYBRID_K).select("query_id", "item_id", "rrf_score", "rrf_rank")


@query(_BM25 + " SELECT query_id, item_id, vector_score, vector_rank FROM vt WHERE vector_score >= 0.3")
def vector_above_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(spark, folder).where("vector_score >= 0.3")


@query(_BM25 + _RERANK + " SELECT * FROM rr")
def rerank_topm(spark: SparkSession, folder: str) -> DataFrame:
    return _reranked(spark, folder)


def _expanded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    seeds = _reranked(spark, folder).where(F.col("reranked_rank") <= S.SEEDS).select("query_id", "item_id", F.col("reranked_score").alias("score"))
    return seeds, G.expand(seeds, K.chunk_edges(spark, folder))


_EXPAND = f""", {K.CE}, seeds AS (SELECT * FROM rr WHERE reranked_rank <= 10),
both_ways AS (SELECT source_chunk AS node, target_chunk AS item_id, similarity FROM ce UNION ALL SELECT target_chunk, source_chunk, similarity FROM ce),
es AS (SELECT s.query_id, b.item_id, round(greatest(max(coalesce(similarity, 0) * reranked_score), 0), 6) AS expansion_score FROM seeds s JOIN both_ways b ON b.node = s.item_id WHERE b.item_id IS NOT NULL GROUP BY 1, 2),
fresh AS (SELECT * FROM es WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = es.query_id AND s.item_id = es.item_id)),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY expansion_score DESC, item_id) AS expansion_rank FROM fresh) WHERE expansion_rank <= 15)"""


@query(_BM25 + _RERANK + _EXPAND + " SELECT * FROM ex")
def chunk_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return _expanded(spark, folder)[1]


@query(_BM25 + _RERANK + _EXPAND + ", a AS (SELECT query_id, item_id, reranked_score AS score, 0 AS expansion_rank FROM seeds UNION ALL SELECT query_id, item_id, expansion_score, expansion_rank FROM ex) SELECT a.*, coalesce(length(c.text), 0) AS n_chars FROM a JOIN c ON c.chunk_id = a.item_id")
def expanded_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds and their neighbours with their texts' lengths; texts are joined last."""
    seeds, more = _expanded(spark, folder)
    rows = seeds.withColumn("expansion_rank", F.lit(0)).unionByName(more.select("query_id", "item_id", F.col("expansion_score").alias("score"), "expansion_rank"))
    return rows.join(_items(spark, folder).select("item_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")), "item_id")


@query(
    f"""WITH {K.C}, p AS (SELECT a.chunk_id AS source_chunk, b.chunk_id AS target_chunk,
    list_sort(list_distinct(list_filter(list_intersect(list_transform(a.entities, lambda e: e.normalized_text), list_transform(b.entities, lambda e: e.normalized_text)), lambda x: x IS NOT NULL))) AS sh,
    round(list_cosine_similarity(a.v, b.v), 6) AS similarity
  FROM c a JOIN c b ON a.document_id = b.document_id AND a.chunk_id < b.chunk_id)
SELECT source_chunk, target_chunk, coalesce(list_aggregate(sh, 'string_agg', ' | '), '') AS shared_entities, coalesce(similarity, -1) AS similarity FROM p WHERE similarity >= 0.72 OR len(sh) > 0"""
)
def chunk_edges(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of a topic are compared, whatever their source."""
    return G.chunk_edges(K.chunks(spark, folder), ["document_id"]).withColumns({"shared_entities": F.array_join("shared_entities", " | "), "similarity": F.coalesce("similarity", F.lit(-1.0))})


@query(
    f"""WITH {K.C}, h AS (SELECT a.chunk_id AS question_id, b.chunk_id AS neighbour_id, round(round(list_cosine_similarity(a.v, b.v), 6), 3) AS similarity
  FROM c a JOIN c b ON a.document_id = b.document_id AND a.chunk_id <> b.chunk_id AND a.v IS NOT NULL AND b.v IS NOT NULL WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.8)
SELECT c.chunk_id AS question_id, coalesce(neighbour_id, '') AS neighbour_id, coalesce(similarity, 0) AS similarity FROM c LEFT JOIN h ON h.question_id = c.chunk_id WHERE c.v IS NOT NULL AND c.document_id IS NOT NULL"""
)
def semantic_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    q = K.chunks(spark, folder).where("embeddings is not null and document_id is not null").select(F.col("chunk_id").alias("question_id"), F.col("embeddings").alias("v"), F.col("document_id").alias("scope"))
    n = G.semantic_neighbours(q).select("question_id", F.explode_outer("semantic_neighbours").alias("n"))
    return n.select("question_id", F.coalesce("n.question_id", F.lit("")).alias("neighbour_id"), F.coalesce("n.similarity", F.lit(0.0)).alias("similarity"))
