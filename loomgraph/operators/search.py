"""Vector and lexical top-k, and their weighted reciprocal-rank fusion."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scoring as S
from loomgraph.functions import text as T
from loomgraph.runtime import shuffle_width

#: Vectors of a block, and about how many a search task holds.
BLOCK, HELD = 2048, 200_000


def _usable(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows with their vectors as one matrix, by length; null, empty and non-finite vectors are left out."""
    b = b[[v is not None and len(v) > 0 for v in b["v"]]]
    for _, group in b.groupby(b["v"].map(len)):
        x = np.array([np.asarray(v, float) for v in group["v"]])
        good = np.isfinite(x).all(1)
        if good.any():
            yield group[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _place(value: object, of: int) -> int:
    """A place below ``of`` that every process computes alike."""
    return zlib.crc32(repr(value).encode("utf-8", "surrogatepass")) % of


def _distinct_items(ids: list, x: np.ndarray) -> tuple[list, np.ndarray]:
    """Repeated ids once, and their unit vectors."""
    order = np.unique(np.array(ids), return_index=True)[1]
    return [ids[o] for o in order], _unit(x[order])


def _best(ids: list, q: np.ndarray, names: list, m: np.ndarray, k: int | None, floor: float | None) -> Iterator[pd.DataFrame]:
    """The k best items (and the query itself, and ties) of each query, or all from ``floor`` on without k."""
    for s in range(0, len(ids), 128):
        sims = np.round(q[s : s + 128] @ m.T, 6) + 0.0
        keep = np.ones(sims.shape, bool) if floor is None else sims >= floor
        if k is not None and k + 1 < sims.shape[1]:
            keep &= sims >= -np.partition(-sims, k, axis=1)[:, k : k + 1]
        i, j = np.nonzero(keep)
        if len(i):
            yield pd.DataFrame({"query_id": [ids[s + n] for n in i], "item_id": [names[n] for n in j], "vector_score": sims[i, j]})


def vector_topk(queries: DataFrame, items: DataFrame, k: int | None = S.VECTOR_K, scope: bool = False, floor: float | None = None) -> DataFrame:
    """The k items of highest cosine for every query, never a query itself; all from ``floor`` on if k is None.

    queries: query_id, v, and scope if asked for; items: item_id, v, scope. With ``scope`` only items of the query's
    scope are compared: a scope is a part of its own, and one of more than HELD items is dealt into several. Otherwise
    items are dealt by their ids into parts of about HELD vectors while the query blocks stream by. Both sides are packed into
    blocks, compared by matrix products; the k best per part are ranked in a last small shuffle.
    Repeated rows count once. Null, empty and non-finite vectors, and those of another length than the query's, take no part; a zero vector has
    cosine 0; a null scope meets nothing. Ties go to the smaller item_id. Result: query_id, item_id, vector_score (6 places), vector_rank.
    """
    width = shuffle_width(items.sparkSession)
    total = items.count()
    if scope:
        large = {}
        if total > HELD:  # fewer than total / HELD
            large = {r[0]: -(-r[1] // HELD) for r in items.groupBy("scope").count().where(F.col("count") > HELD).collect()}
        tasks = max(width, -(-total // HELD))
        found = _scoped(queries, items, k, floor, tasks, large)
    else:
        found = _unscoped(queries, items, k, floor, max(1, -(-total // HELD)), width)
    hits = found.where("not query_id <=> item_id").distinct()
    return ranked(hits, "vector_score", "vector_rank", k)


_BLOCKS = "task int, kind int, block binary"


def _schema(queries: DataFrame, items: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, vector_score double"


def _unscoped(queries: DataFrame, items: DataFrame, k: int | None, floor: float | None, parts: int, width: int) -> DataFrame:
    lanes = max(1, -(-width // parts))

    def pack(kind: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for group, x in _usable(b):
                    ids = group.iloc[:, 0].tolist()
                    for s in range(0, len(ids), BLOCK):
                        piece = pickle.dumps((ids[s : s + BLOCK], x[s : s + BLOCK]), 5)
                        own = _place(ids[s : s + BLOCK], parts if kind == 0 else lanes)
                        yield pd.DataFrame({"task": [own * lanes + j for j in range(lanes)] if kind == 0 else [j * lanes + own for j in range(parts)], "kind": kind, "block": piece})

        return run

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        ready: dict[int, tuple] = {}
        for b in batches:
            for kind, raw in zip(b["kind"], b["block"]):
                ids, x = pickle.loads(raw)
                dim = x.shape[1]
                if kind == 0:
                    held.setdefault(dim, []).append((ids, x))
                elif dim in held or dim in ready:
                    if dim not in ready:
                        blocks = held.pop(dim)
                        ready[dim] = _distinct_items([i for ids_, _ in blocks for i in ids_], np.concatenate([v for _, v in blocks]))
                    yield from _best(ids, _unit(x), *ready[dim], k, floor)

    both = items.select("item_id", "v").mapInPandas(pack(0), _BLOCKS).unionByName(queries.select("query_id", "v").mapInPandas(pack(1), _BLOCKS))
    return both.repartitionById(parts * lanes, "task").sortWithinPartitions("kind").mapInPandas(run, _schema(queries, items))


def _scoped(queries: DataFrame, items: DataFrame, k: int | None, floor: float | None, tasks: int, large: dict) -> DataFrame:
    def pack(kind: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for group, x in _usable(b[b["scope"].notna()]):
                    ids, scopes = group.iloc[:, 0].tolist(), group["scope"].tolist()
                    to: dict[int, list[int]] = {}
                    for n, (i, s) in enumerate(zip(ids, scopes)):
                        deals = large.get(s, 1)
                        for deal in range(deals) if kind else (_place(i, deals),):
                            to.setdefault(_place((s, deal), tasks), []).append(n)
                    for task, rows in to.items():
                        yield pd.DataFrame({"task": [task], "kind": kind, "block": [pickle.dumps(([ids[n] for n in rows], [scopes[n] for n in rows], x[rows]), 5)]})

        return run

    def by_scope(scopes: list) -> dict:
        out: dict = {}
        for n, s in enumerate(scopes):
            out.setdefault(s, []).append(n)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        ready: dict[tuple, tuple] = {}
        for b in batches:
            for kind, raw in zip(b["kind"], b["block"]):
                ids, scopes, x = pickle.loads(raw)
                for s, rows in by_scope(scopes).items():
                    key, own = (x.shape[1], s), [ids[n] for n in rows]
                    if kind == 0:
                        held.setdefault(key, []).append((own, x[rows]))
                    elif key in held or key in ready:
                        if key not in ready:
                            blocks = held.pop(key)
                            ready[key] = _distinct_items([i for ids_, _ in blocks for i in ids_], np.concatenate([v for _, v in blocks]))
                        yield from _best(own, _unit(x[rows]), *ready[key], k, floor)

    both = items.select("item_id", "v", "scope").mapInPandas(pack(0), _BLOCKS).unionByName(queries.select("query_id", "v", "scope").mapInPandas(pack(1), _BLOCKS))
    return both.repartitionById(tasks, "task").sortWithinPartitions("kind").mapInPandas(run, _schema(queries, items))


def ranked(hits: DataFrame, score: str, rank: str, k: int | None, per: str = "query_id", tie: str = "item_id") -> DataFrame:
    by = Window.partitionBy(per).orderBy(F.col(score).desc(), F.col(tie))
    rows = hits.withColumn(rank, F.row_number().over(by))
    return rows if k is None else rows.where(F.col(rank) <= k)


def postings(items: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(scope, item_id, field, term, tf, length) of every field's tokens; fields are arrays of texts or texts."""
    each = [F.struct(F.lit(n).alias("field"), c.alias("tokens")) for n, c in fields.items()]
    docs = items.select("scope", "item_id", F.explode(F.array(*each)).alias("f")).select("scope", "item_id", "f.field", "f.tokens")
    words = docs.where("tokens is not null").select("scope", "item_id", "field", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return words.groupBy("scope", "item_id", "field", "length", "term").agg(F.count("*").alias("tf"))


def bm25_topk(queries: DataFrame, items: DataFrame, fields: dict[str, Column], k: int = S.VECTOR_K, wide: bool = False) -> DataFrame:
    """The k items of highest BM25 for every query, within the query's scope.

    queries: query_id, scope, query; items: scope, item_id and what the fields read. Statistics (documents, document
    frequency, mean length) are taken per scope and field, or over all with ``wide``; field scores are added. Only the
    postings of query terms are scored: the terms' statistics join the postings by (scope, field, term).
    A query without tokens, or null, has no hits; empty fields count in no statistics.
    Result: query_id, item_id, bm25_score (6 places), bm25_rank.
    """
    return lexical_topk(queries, postings(items, fields), k, wide)


def lexical_topk(queries: DataFrame, post: DataFrame, k: int = S.VECTOR_K, wide: bool = False) -> DataFrame:
    """bm25_topk over a table of postings, which is written once (``materialize``) and serves any number of queries."""
    span = [] if wide else ["scope"]
    docs = post.groupBy(*["scope", "item_id", "field"]).agg(F.first("length").alias("length"))
    stats = docs.groupBy(*span, "field").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    terms = queries.select("query_id", "scope", F.explode(F.array_distinct(T.lowered_tokens(F.col("query")))).alias("term"))
    hits = post.join(terms, ["scope", "term"])
    df = post.join(terms.select(*span, "term").distinct(), [*span, "term"], "left_semi").groupBy(*span, "field", "term").agg(F.count("*").alias("df"))
    scored = hits.join(df, [*span, "field", "term"]).join(stats, [*span, "field"])
    part = S.bm25_term(F.col("tf"), F.col("length"), F.col("mean_length"), F.col("n"), F.col("df"))
    total = scored.groupBy("query_id", "item_id").agg(F.round(F.sum(part), 6).alias("bm25_score"))
    return ranked(total, "bm25_score", "bm25_rank", k)


def fuse(vector: DataFrame, lexical: DataFrame, vector_weight: float = 0.5, lexical_weight: float = 0.5, k: int = S.RRF_K) -> DataFrame:
    """Full join of both hit lists with the weighted sum of reciprocal ranks; ties go to the smaller item_id."""
    both = vector.join(lexical, ["query_id", "item_id"], "full")
    score = S.reciprocal_rank(F.col("vector_rank"), vector_weight, k) + S.reciprocal_rank(F.col("bm25_rank"), lexical_weight, k)
    by = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "item_id")
    return both.withColumn("rrf_score", F.round(score, 9)).withColumn("rrf_rank", F.row_number().over(by))


def rerank(hits: DataFrame, queries: DataFrame, items: DataFrame, m: int = S.RERANK_K) -> DataFrame:
    """The m hits with the largest idf-weighted share of the query's tokens in their text.

    hits: query_id, item_id; queries: query_id, query; items: item_id, text. The score is the sum of idf over shared
    tokens divided by the sum over all query tokens, with idf = ln(1 + N / df) over all items. A null text or a query
    without tokens scores 0. Result: query_id, item_id, reranked_score, reranked_rank.
    """
    texts = items.select("item_id", F.lit(None).cast("string").alias("scope"), "text")
    return rerank_indexed(hits, queries, postings(texts, {"text": T.lowered_tokens(F.col("text"))}), items.count(), m)


def rerank_indexed(hits: DataFrame, queries: DataFrame, post: DataFrame, n: int, m: int = S.RERANK_K) -> DataFrame:
    """rerank over a table of postings of n items; only the postings of query terms are read, and no text."""
    words = queries.select("query_id", F.explode_outer(F.array_distinct(T.lowered_tokens(F.col("query")))).alias("term"))
    used = words.select("term").where("term is not null").distinct()
    found = post.where("field = 'text'").select("item_id", "term").join(used, "term", "left_semi").distinct()
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = used.join(df, "term", "left").select("term", F.when(F.coalesce("df", F.lit(0)) > 0, F.log(1 + F.lit(n) / F.col("df"))).otherwise(0.0).alias("idf"))
    rows = hits.select("query_id", "item_id").distinct().join(words, "query_id").join(idf, "term", "left").join(found.withColumn("got", F.lit(True)), ["item_id", "term"], "left")
    share = F.coalesce(F.try_divide(F.sum(F.when(F.col("got"), F.col("idf"))), F.sum("idf")), F.lit(0.0))
    return ranked(rows.groupBy("query_id", "item_id").agg(F.round(share, 6).alias("reranked_score")), "reranked_score", "reranked_rank", m)
