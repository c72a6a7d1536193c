import math

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import scoring as S
from loomgraph.functions.text import lowered_tokens
from loomgraph.operators import edges as G
from loomgraph.operators import search as Q


def test_vector_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).round(2)
    x[7] = x[3]
    rows = [(i, v.tolist(), "ab"[i % 2], "extra") for i, v in enumerate(x)] + [(100, None, "a", ""), (101, [], "a", ""), (102, [float("nan")] * 5, "a", ""), (103, [0.0] * 5, "a", ""), (3, x[3].tolist(), "b", "extra")]
    df = spark.createDataFrame(rows, "item_id int, v array<double>, scope string, query_id_x string")
    queries = df.where("item_id % 10 = 3").select(F.col("item_id").alias("query_id"), "v", "scope").distinct()
    got = {(r.query_id, r.vector_rank): r.item_id for r in Q.vector_topk(queries, df, 4, scope=True).collect()}
    for q in range(3, 60, 10):
        sims = sorted((-round(float(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])), 6), i) for i in range(60) if i != q and i % 2 == q % 2)
        if 103 and q % 2 == 0:
            sims = sorted([*sims, (0.0, 103)])
        assert [got[q, r] for r in range(1, 5)] == [i for _, i in sims[:4]]
    none = Q.vector_topk(queries, df.where("false"), 4)
    assert none.count() == 0


def test_blocks_are_dealt_evenly():
    """Blocks of 2,000 partitions, which start alike, spread over 100 parts; every process places them alike."""
    places = [Q._place([f"v{p}-{i}" for i in range(5)], 100) for p in range(2000) for _ in range(5)]
    assert max(np.bincount(places, minlength=100)) <= 2 * 100


def test_large_scopes_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD", 30)
    rng = np.random.default_rng(3)
    rows = [(f"i{i:03d}", ["hot", "b", "c", None][min(i % 5, 3)] if i % 2 else "hot", rng.normal(size=4).tolist()) for i in range(200)]
    items = spark.createDataFrame(rows, "item_id string, scope string, v array<double>")
    queries = items.withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r.item_id): r.vector_rank for r in Q.vector_topk(queries, items, 3, scope=True).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {}
    for i, s, _ in rows:
        near = sorted((-round(float(x[i] @ x[j]), 6), j) for j, t, _ in rows if s is not None and t == s and j != i)
        want |= {(i, j): n for n, (_, j) in enumerate(near[:3], 1)}
    assert got == want
    every = Q.vector_topk(queries, items, None, scope=True, floor=0.5)
    assert {(r.query_id, r.item_id) for r in every.collect()} == {(i, j) for i, s, _ in rows for j, t, _ in rows if s is not None and s == t and i != j and round(float(x[i] @ x[j]), 6) >= 0.5}


def test_bm25_by_hand(spark):
    items = spark.createDataFrame([("a", "t", "red red blue"), ("b", "t", "blue"), ("c", "u", "red"), ("d", "t", None), ("e", "t", "")], "item_id string, scope string, text string")
    queries = spark.createDataFrame([("q", "t", "Red!"), ("none", "t", None), ("empty", "t", "...")], "query_id string, scope string, query string")
    got = Q.bm25_topk(queries, items, {"text": lowered_tokens(F.col("text"))}).collect()
    idf = math.log(1 + (2 - 1 + 0.5) / (1 + 0.5))
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))
    assert [(r.query_id, r.item_id, r.bm25_rank) for r in got] == [("q", "a", 1)] and abs(got[0].bm25_score - want) < 1e-6
    wide = {r.item_id for r in Q.bm25_topk(queries, items, {"text": lowered_tokens(F.col("text"))}, wide=True).collect()}
    assert wide == {"a"}


def test_fusion(spark):
    v = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)], "query_id string, item_id string, vector_score double, vector_rank int")
    b = spark.createDataFrame([("q", "b", 3.0, 1), ("q", "c", 2.0, 2)], "query_id string, item_id string, bm25_score double, bm25_rank int")
    got = {r.item_id: (r.rrf_score, r.rrf_rank) for r in Q.fuse(v, b).collect()}
    assert got["b"] == (round(0.5 / 62 + 0.5 / 61, 9), 1) and got["a"][1] == 2 and got["c"][1] == 3
    swapped = {r.item_id: r.rrf_score for r in Q.fuse(b.selectExpr("query_id", "item_id", "bm25_score vector_score", "bm25_rank vector_rank"), v.selectExpr("query_id", "item_id", "vector_score bm25_score", "vector_rank bm25_rank")).collect()}
    assert swapped == {k: s for k, (s, _) in got.items()}


def test_rerank(spark):
    items = spark.createDataFrame([("a", "red blue"), ("b", "green"), ("c", None)], "item_id string, text string")
    hits = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("q", "a")], "query_id string, item_id string")
    queries = spark.createDataFrame([("q", "red unknown")], "query_id string, query string")
    got = [(r.item_id, r.reranked_score, r.reranked_rank) for r in Q.rerank(hits, queries, items, 2).orderBy("reranked_rank").collect()]
    assert got == [("a", 1.0, 1), ("b", 0.0, 2)]


def test_expansion_is_symmetric(spark):
    seeds = spark.createDataFrame([("q", "s1", 0.5), ("q", "s2", 1.0)], "query_id string, item_id string, score double")
    rows = [("s1", "x", 0.9), ("y", "s2", 0.6), ("s2", "x", 0.3), ("s1", "s2", 1.0), ("s1", None, 1.0), ("s1", "z", None)]
    e = spark.createDataFrame(rows, "source_chunk string, target_chunk string, similarity double")
    got = [(r.item_id, r.expansion_score) for r in G.expand(seeds, e).orderBy("expansion_rank").collect()]
    assert got == [("y", 0.6), ("x", 0.45), ("z", 0.0)]
    back = e.selectExpr("target_chunk source_chunk", "source_chunk target_chunk", "similarity")
    assert [(r.item_id, r.expansion_score) for r in G.expand(seeds, back).orderBy("expansion_rank").collect()] == got


def test_edges_and_neighbours(spark):
    ent = "array<struct<text:string,normalized_text:string,label:string,score:double>>"
    rows = [("a", "t", [1.0, 0.0], [("x", "x", "l", 1.0)]), ("b", "t", [1.0, 0.1], []), ("c", "t", [0.0, 1.0], [("x", "x", "l", 1.0), ("x", None, "l", 1.0)]), ("d", "u", [1.0, 0.0], [("x", "x", "l", 1.0)]), ("e", "t", None, None)]
    c = spark.createDataFrame(rows, f"chunk_id string, document_id string, embeddings array<double>, entities {ent}")
    got = {(r.source_chunk, r.target_chunk): (r.shared_entities, r.similarity) for r in G.chunk_edges(c, ["document_id"]).collect()}
    assert got == {("a", "b"): ([], round(1 / math.sqrt(1.01), 6)), ("a", "c"): (["x"], 0.0)}
    q = spark.createDataFrame([("p", "s", [1.0, 0.0]), ("r", "s", [1.0, 0.0]), ("t", "s", [0.0, 1.0])], "question_id string, scope string, v array<double>")
    n = {r.question_id: [(x.question_id, x.similarity) for x in r.semantic_neighbours] for r in G.semantic_neighbours(q).collect()}
    assert n == {"p": [("r", 1.0)], "r": [("p", 1.0)], "t": []}


def test_edges_across_sources_and_blocks(spark, tmp_path):
    from loomgraph.plans import retrieval

    rng = np.random.default_rng(5)
    ent = "array<struct<text:string,normalized_text:string,label:string,score:double>>"
    rows = []
    for i in range(90):
        v = (rng.normal(size=64) + 2 * np.eye(64)[i % 3] * 6).round(3).tolist()
        names = sorted({f"e{x}" for x in rng.integers(0, 40, 2)})
        rows.append((f"c{rng.integers(10**9)}-{i}", "tu"[i % 5 == 0], [None, "s1", "s2"][i % 3], None if i % 11 == 0 else v, [(x, x, "l", 1.0) for x in names]))
    c = spark.createDataFrame(rows, f"chunk_id string, document_id string, source_id string, embeddings array<double>, entities {ent}")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1]:
                shared = sorted({e[1] for e in a[4]} & {e[1] for e in b[4]})
                cos = None if a[3] is None or b[3] is None else round(float(np.dot(a[3], b[3]) / np.linalg.norm(a[3]) / np.linalg.norm(b[3])), 6)
                if shared or (cos is not None and cos >= 0.72):
                    want[a[0], b[0]] = (shared, cos)
    assert any(not s for s, _ in want.values()) and any(s for s, _ in want.values())
    for block in (4096, 10):
        found = G.chunk_edges(c, ["document_id"], block=block).collect()
        assert len(found) == len(want) and {(r.source_chunk, r.target_chunk): (r.shared_entities, r.similarity) for r in found} == want
    c.write.parquet(str(tmp_path / "chunks.parquet"))
    assert {(r.source_chunk, r.target_chunk) for r in retrieval.chunk_edges(spark, str(tmp_path)).collect()} == set(want)


def test_copies_of_a_chunk_are_bounded(spark):
    n, block = 600, 10
    c = spark.range(n).selectExpr("concat('c', id) chunk_id", "'t' document_id", "array(1d, cast(id as double)) embeddings", "cast(array() as array<struct<text:string,normalized_text:string,label:string,score:double>>) entities")
    edges = G.chunk_edges(c, ["document_id"], threshold=2.0, block=block)
    assert edges.count() == 0
    copies = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
            return walk(node.plan())
        if name == "Generate":
            copies.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    edges.collect()
    walk(edges._jdf.queryExecution().executedPlan())
    assert copies and max(copies) <= n * -(-n // (8 * block))  # not n / block each


def shuffled_bytes(df):
    """Bytes that the shuffles of a collected frame wrote."""
    total = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
            return walk(node.plan())
        if name == "Exchange":
            total.append(node.metrics().apply("shuffleBytesWritten").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(total)


def test_copies_travel_packed(spark):
    from hashlib import sha256

    rng = np.random.default_rng(8)
    ent = "array<struct<text:string,normalized_text:string,label:string,score:double>>"
    n, rows = 1200, []
    for i in range(n):
        v = rng.poisson(0.6, 64) * rng.choice([-1.0, 1.0], 64)
        v = (v / np.linalg.norm(v)).tolist()
        v = [None, v[:63], [], [math.nan, *v[1:]], [-0.0, *v[1:]]][i % 5] if i < 40 else v
        rows.append((sha256(b"%d" % i).hexdigest(), "t", v, [(x, x, "l", 1.0) for x in [f"e{i % 300}"]]))
    c = spark.createDataFrame(rows, f"chunk_id string, document_id string, embeddings array<double>, entities {ent}")
    want = {}
    by = sorted(rows)
    for k, a in enumerate(by):
        for b in by[k + 1 :]:
            shared = sorted({e[1] for e in a[3]} & {e[1] for e in b[3]})
            cos = None if not a[2] or not b[2] or len(a[2]) != len(b[2]) else float(np.round(np.dot(a[2], b[2]) / np.linalg.norm(a[2]) / np.linalg.norm(b[2]), 6)) + 0.0
            if shared or (cos is not None and cos >= 0.5):
                want[a[0], b[0]] = (shared, str(cos))
    edges = G.chunk_edges(c, ["document_id"], threshold=0.5, block=100)
    found = edges.collect()
    assert len(found) == len(want) and {(r.source_chunk, r.target_chunk): (r.shared_entities, str(r.similarity)) for r in found} == want
    assert shuffled_bytes(edges) < 2 * n * 150  # two copies a chunk; 64 numbers alone take 512 bytes


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - math.sqrt(0.5)) < 1e-12 and got[1:] == [0.0, None]
