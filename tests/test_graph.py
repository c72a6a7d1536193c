from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.operators import graph as G
from loomgraph.operators import chunking, knowledge
from loomgraph.operators import questions as B
from loomgraph.operators import references as R
from loomgraph.operators import relations as L
from loomgraph.operators import skew
from loomgraph.operators.components import connected_components

ENT = "array<struct<text:string,normalized_text:string,label:string,score:double>>"


def edge_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, source string, relation string, target string, edge_type string, weight double, edge_id string")


def test_dedup_prune_validate(spark):
    rows = [("c", "a", "r", "b", "semantic", 0.9, "1"), ("c", "a", "r", "b", "semantic", 0.8, "2"), ("c", "b", "co_occurs", "a", "contextual", 0.2, "3"), ("c", "a", "co_occurs", "d", "contextual", 0.2, "4"), ("k", "b", "co_occurs", "a", "contextual", 0.2, "5"), ("c", "a", "r", "a", "semantic", 0.5, "6"), ("c", None, "r", "a", "other", 0.5, "7")]
    e = edge_frame(spark, rows)
    assert {r.edge_id for r in L.first_relations(e, [F.col("edge_id")]).collect()} == {"1", "3", "4", "5", "6", "7"}
    assert {r.edge_id for r in L.prune_contextual(e).collect()} == {"1", "2", "4", "5", "6"}
    chunks = spark.createDataFrame([("c", [("A", "a", "l", 1.0), ("B", "b", "l", 1.0)]), ("k", None)], f"chunk_id string, entities {ENT}")
    assert {r.edge_id for r in L.valid_relations(e, chunks).collect()} == {"1", "2", "3"}


def test_canonical_and_expansion(spark):
    d = spark.createDataFrame([("uses", ["employs", "utilizes"]), ("is_a", None)], "relation string, phrases array<string>")
    rows = spark.createDataFrame([("employs",), ("uses",), ("eats",), (None,)], "relation string")
    assert {r.relation: r.canonical for r in L.canonical_relations(rows, d).collect()} == {"employs": "uses", "uses": "uses", "eats": "eats", None: None}
    assert {r.relation: r.canonical for r in L.canonical_relations(rows, d, fallback="associated_with").collect()}["eats"] == "associated_with"
    e = edge_frame(spark, [("c", "x", "r", "b", "semantic", 0.3, "1"), ("c", "a", "r", "x", "semantic", 0.5, "2"), ("c", "x", "r", "z", "semantic", 0.29, "3"), ("c", "x", "r", "n", "semantic", float("nan"), "4")])
    q = spark.createDataFrame([(" X ",), ("lost",)], "query string")
    assert {r.query: r.expanded_query for r in L.expand_queries(q, e).collect()} == {" X ": "a b", "lost": ""}


def test_cooccurrence(spark):
    ents = [("risk", "risk", "l", 1.0), ("loss", "loss fn", "l", 1.0), ("bias", "bias", "l", 1.0), ("losses", "loss fn", "l", 1.0)]
    c = spark.createDataFrame([("c", "The risk [3] and the loss. No lossy word here! Bias meets loss and losses.", ents), ("d", None, ents), ("e", "risk loss", None)], f"chunk_id string, text string, entities {ENT}")
    got = {(r.source, r.target, r.explanation[:4]) for r in L.co_occurrences(c).collect()}
    assert got == {("risk", "loss fn", "The "), ("loss fn", "bias", "Bias")}


def test_relations_by_pattern(spark):
    ents = [{"text": t, "normalized_text": n, "label": "m", "score": 1.0} for t, n in (("adam", "adam"), ("sgd", "sgd"), ("momentum", "momentum"))]
    text = "Notes:\n- Adam builds upon SGD\n- Adam is fast. SGD uses momentum [3]. Momentum, not used by Adam."
    c = spark.createDataFrame([("c", text, ents), ("n", None, ents), ("e", "Adam uses SGD", None)], f"chunk_id string, text string, entities {ENT}")
    d = spark.createDataFrame([("extends", ["builds upon"]), ("uses", None)], "relation string, phrases array<string>")
    got = sorted((r.chunk_id, r.source, r.relation, r.target, r.explanation) for r in L.pattern_relations(c, d).collect())
    assert got == [("c", "adam", "extends", "sgd", "- Adam builds upon SGD"), ("c", "sgd", "uses", "momentum", "SGD uses momentum [3].")]
    assert len(L.pattern_relations(c, d, most=1).collect()) == 1


def test_long_names_are_extracted(spark):
    k = spark.createDataFrame([("deep net", "method", ["the very long name of a deep net"]), ("loss", "term", None)], "name string, label string, aliases array<string>")
    c = spark.createDataFrame([("c", "Here is the Very long name of a deep-net, and loss."), ("d", None), ("e", "loss"), ("f", "")], "chunk_id string, text string")
    got = {(r.chunk_id, r.text, r.normalized_text) for r in L.extract_entities(c, k).collect()}
    assert got == {("c", "the very long name of a deep net", "deep net"), ("c", "deep net", "deep net"), ("c", "loss", "loss"), ("e", "loss", "loss")}
    assert L.extract_entities(c, k.where("false")).count() == 0


def test_paths_by_hand(spark):
    e = edge_frame(spark, [("c", "a", "r", "b", "semantic", 0.9, "1"), ("c", "b", "r", "d", "contextual", 0.5, "2"), ("c", "b", "r", "f", "semantic", 0.8, "3"), ("c", "f", "r", "a", "semantic", 0.1, "4"), ("c", "a", "r", "a", "semantic", 1.0, "5"), ("c", "a", "r", None, "semantic", 1.0, "6"), ("c", "a", "r", "g", "semantic", float("nan"), "7")])
    u = G.undirected(e)
    assert u.count() == 8
    got = {(r.nodes, r.quality, r.path_score) for r in G.paths(u, 2).where("entity = 'a'").collect()}
    assert got == {("a > b > f", "strong", 0.72), ("a > b > d", "weak", 0.45)}
    assert {r.nodes for r in G.paths(u, 3).collect()} == set()
    assert G.paths(u.where("false"), 2).count() == 0
    assert [(r.node, r.neighbour) for r in G.top_neighbours(u, 1).where("node = 'b'").collect()] == [("b", "a")]


def test_paths_against_all_paths(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(7)
    # hubs, ties of weights, weights within the rounding of the score, and nodes most of whose paths meet again
    rows = {}
    for i in range(700):
        a, b = (f"n{rng.randrange(k):02}" for k in (4 if i % 2 else 60, 60))
        rows[min(a, b), max(a, b)] = rng.choice([0.9, 0.95, 1.0, 0.3, round(rng.random(), 3), 0.9 + rng.random() / 1e6])
    e = edge_frame(spark, [("c", a, "r", b, "semantic" if (len(a + b) + i) % 3 else "contextual", w, str(i)) for i, ((a, b), w) in enumerate(rows.items())])
    u = G.undirected(e).cache()
    near = {}
    for r in u.collect():
        near.setdefault(r.node, []).append((r.neighbour, r.weight, r.semantic))
    for hops, strong, weak in ((1, 2, 1), (2, 5, 3), (3, 3, 2), (4, 2, 1)):
        walks = [((n,), 1.0, True) for n in near] if hops < 4 else [((n,), 1.0, True) for n in sorted(near)[:3]]
        for _ in range(hops):
            walks = [((*p, y), s * w, q and k) for p, s, q in walks for y, w, k in near[p[-1]] if y not in p and s * w >= 0.2]
        best = {}
        for p, s, q in walks:
            best.setdefault((p[0], "strong" if q else "weak"), []).append((-float(Decimal(repr(s)).quantize(Decimal("1e-6"), ROUND_HALF_UP)), " > ".join(p)))
        want = {(k, i + 1): x for k, v in best.items() for i, x in enumerate(sorted(v)[: strong if k[1] == "strong" else weak])}
        got = {((r.entity, r.quality), r.path_rank): (-r.path_score, r.nodes) for r in G.paths(u, hops, strong=strong, weak=weak).collect() if hops < 4 or r.entity in sorted(near)[:3]}
        assert got == want


def test_packet_and_rendered_context(spark, tmp_path):
    from loomgraph.plans import graph_queries

    ents = lambda *names: [(n, n, "equation" if "=" in n else "concept", 1.0) for n in names]
    rows = [("c1", "t", "s", "Text one.", ents("a", "b", "x = 1")), ("c2", "t", "s", "Text two.", ents("b", "d", "f", "x = 1")), ("c4", "t", "r", "Text two.", None), ("c3", "u", "s", "Other.", ents("a", "b", "d"))]
    vector = [1.0] * 64
    spark.createDataFrame([(*r[:4], vector, r[4]) for r in rows], f"chunk_id string, document_id string, source_id string, text string, embeddings array<double>, entities {ENT}").write.parquet(str(tmp_path / "chunks.parquet"))
    edges = [("c1", "a", "uses", "b", "semantic", 0.9, "1"), ("c2", "b", "part_of", "d", "contextual", 0.5, "2"), ("c2", "d", "is_a", "f", "semantic", 0.8, "3"), ("c3", "a", "beats", "d", "semantic", 1.0, "4"), ("c1", "a", "r", "elsewhere", "semantic", 1.0, "5"), ("lost", "b", "r", "f", "semantic", 1.0, "6"), ("c2", "f", "co_occurs", "x = 1", "contextual", 0.1, "7")]
    edge_frame(spark, edges).write.parquet(str(tmp_path / "entity_edges.parquet"))
    text = {(r.topic_id, r.difficulty): r.context for r in graph_queries.rendered_context(spark, str(tmp_path)).collect()}
    common = "## Available Entities\n['a', 'b', 'd', 'f', 'x = 1']\n\n## Supporting Knowledge\n['Text one.', 'Text two.']\n"
    two = ["[w|0.4500] a- uses -> b- part_of -> d", "[w|0.4000] b- part_of -> d- is_a -> f", "[w|0.4500] d- part_of -> b- uses -> a", "[w|0.4000] f- is_a -> d- part_of -> b"]
    three = ["[w|0.3600] a- uses -> b- part_of -> d- is_a -> f", "[w|0.3600] f- is_a -> d- part_of -> b- uses -> a"]
    assert text["t", "easy"] == common
    assert text["t", "medium"] == common + "\n" + "\n".join(["## Concept Paths (2-Hop)", *two, "", "## Retrieved Equations", "[EQ] x = 1 \n INTUITION: Text one.", "[EQ] x = 1 \n INTUITION: Text two.", ""])
    assert text["t", "hard"] == common + "\n" + "\n".join(["## Concept Paths (3-Hop)", *three, "", "## Related Equations", "[EQ] x = 1 \n INTUITION: f", ""])
    assert "(2-Hop)\n\n\n## Retrieved Equations\nNone\n" in text["u", "medium"]
    packet = {r.topic_id: r for r in graph_queries.topic_packet(spark, str(tmp_path)).collect()}
    assert packet["t"].supporting_chunks == "Text one. | Text two." and packet["t"].concept_paths_2_hop == "\n".join(two) and packet["u"].core_concepts == "a | b | d"


def packet_tables(spark, folder):
    ents = lambda *names: [(n, n, "equation" if "=" in n else "concept", 1.0) for n in names]
    rows = [(f"c{i}", "tuv"[i % 3], "s", [None, "Alike.", "Alike.", f"Text {i}, it's 'ön'.", ""][i % 5], ents("a", "b", f"n{i % 7}", "x = 1", f"y = {i % 4}")) for i in range(40)] + [("lone", "w", "s", None, None)]
    spark.createDataFrame([(*r[:4], [1.0] * 64, r[4]) for r in rows], f"chunk_id string, document_id string, source_id string, text string, embeddings array<double>, entities {ENT}").write.parquet(f"{folder}/chunks.parquet")
    edges = [(f"c{i % 40}", "abx"[i % 3] if i % 3 < 2 else "x = 1", ["uses", "co_occurs"][i % 2], f"n{i % 5}", ["semantic", "contextual"][i % 2], 0.5 + i % 50 / 100, str(i)) for i in range(120)]
    edge_frame(spark, edges).write.parquet(f"{folder}/entity_edges.parquet")


def gathers(df):
    """Whether a topic's gathered values are joined to its row, so that all of them pass the joins at once."""
    return "LeftOuter" in df._jdf.queryExecution().analyzed().toString()


def test_question_bank_gathers_no_topic(spark, tmp_path):
    from loomgraph.plans import graph_queries

    packet_tables(spark, tmp_path)
    bank = graph_queries.question_bank(spark, str(tmp_path))
    assert not gathers(bank)
    got = {(r.topic, r.difficulty, r.question, r.primary_concept) for r in bank.collect()}
    assert ("t", "easy", "What is y = 3?", "y = 3") in got and {d for _, d, _, _ in got} == {"easy", "medium", "hard"} and {t for t, _, _, _ in got} == {"t", "u", "v"}


def packets_as_rendered(spark, folder):
    from loomgraph.functions import rendering as X
    from loomgraph.plans import common as K

    p = G.topic_packets(K.chunks(spark, folder), spark.read.parquet(f"{folder}/entity_edges.parquet"))
    text = {k: X.render_paths(F.col("concept_paths")[k]) for k in ("2_hop", "3_hop")} | {k: X.render_equations(F.col(k)) for k in ("retrieved_equations", "related_equations")}
    return p.withColumns({f"_{k}": v for k, v in text.items()})


def test_packets_pass_in_order(spark, tmp_path):
    from loomgraph.plans import graph_queries

    packet_tables(spark, tmp_path)
    want = packets_as_rendered(spark, str(tmp_path)).select("topic_id", F.array_join("core_concepts", " | "), F.array_join("supporting_chunks", " | "), "_2_hop", "_3_hop", "_retrieved_equations", "_related_equations").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # repeated rows and topics reach over batches
    try:
        packets = graph_queries.topic_packet(spark, str(tmp_path))
        assert not gathers(packets)
        assert sorted(tuple(r) for r in packets.collect()) == sorted(tuple(r) for r in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ("w", "", "", "", "", "None", "None") in {tuple(r) for r in want}


def test_contexts_pass_in_order(spark, tmp_path):
    from loomgraph.functions import rendering as X
    from loomgraph.plans import graph_queries

    packet_tables(spark, tmp_path)
    rows = packets_as_rendered(spark, str(tmp_path)).withColumn("difficulty", F.explode(F.array(*map(F.lit, ("easy", "medium", "hard")))))
    text = X.render_context(F.col("difficulty"), X.render_list(F.col("core_concepts")), X.render_list(F.col("supporting_chunks")), *map(F.col, ("_2_hop", "_3_hop", "_retrieved_equations", "_related_equations")))
    want = {tuple(r) for r in rows.select("topic_id", "difficulty", text).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = graph_queries.rendered_context(spark, str(tmp_path))
        assert not gathers(got) and got.count() == 12
        assert {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_to_knowledge(spark):
    page = lambda t: f"<html><body><div class='toc'>x</div><p>{t}</p></body></html>"
    rows = [(1, "t", "s", page("Adam builds upon SGD. Adam needs momentum.")), (2, "t", "s", page("SGD and Adam differ much here.")), (3, "u", "s", "<p>no root</p>"), (4, "u", None, None), (5, "u", "s", page("Nothing said.")), (1, "t", "s", page("Adam builds upon SGD. Adam needs momentum."))]
    pages = spark.createDataFrame(rows, "page_id long, topic_id string, source_id string, html string")
    catalog = spark.createDataFrame([(1, "adam", "m", None), (2, "sgd", "m", ["sgd method"]), (3, "momentum", "m", None)], "entity_no int, name string, label string, aliases array<string>")
    verbs = spark.createDataFrame([("extends", ["builds upon"])], "relation string, phrases array<string>")
    k = knowledge.build(pages, catalog, verbs)
    chunks = {r.text: r for r in k.chunks.collect()}
    assert set(chunks) == {"Adam builds upon SGD. Adam needs momentum.", "SGD and Adam differ much here.", "Nothing said."} and all(len(r.embeddings) == 64 for r in chunks.values())
    got = sorted((r.source, r.relation, r.target, r.edge_type) for r in k.relations.collect())
    assert got == [("adam", "co_occurs", "momentum", "contextual"), ("adam", "co_occurs", "sgd", "contextual"), ("adam", "extends", "sgd", "semantic")]
    edges = k.chunk_edges.collect()
    assert len(edges) == 1 and edges[0].shared_entities == ["adam", "sgd"]
    assert sorted((r.item, r.stage) for r in k.rejected.collect()) == [("3", "page"), ("4", "page")]
    assert {r.chunk_id for r in knowledge.build(pages.repartition(3), catalog, verbs).chunks.collect()} == {r.chunk_id for r in chunks.values()}

    def broken(c, catalog):  # an extractor that fails on one chunk
        return L.extract_entities(c, catalog).withColumn("score", F.when(F.col("normalized_text") == "momentum", 7.0).otherwise(F.col("score")))

    k = knowledge.build(pages, catalog, verbs, knowledge.Providers(entities=broken))
    assert k.chunks.count() == 2 and [r.reason for r in k.rejected.where("stage = 'chunk'").collect()] == ["entity score in [0, 1]"]
    assert knowledge.build(pages.where("false"), catalog, verbs).chunk_edges.count() == 0


def test_build_leaves_no_text_behind(spark):
    from pathlib import Path

    rows = [(1, "t", "s", "Adam builds upon SGD."), (1, "u", "s", "Another text."), (2, "t", "s", "")]
    pages = spark.createDataFrame([(*r[:3], f"<html><body><div class='toc'>x</div><p>{r[3]}</p></body></html>") for r in rows], "page_id long, topic_id string, source_id string, html string")
    catalog = spark.createDataFrame([(1, "adam", "m", None)], "entity_no int, name string, label string, aliases array<string>")
    folder = Path(runtime.shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("cut-*"))
    k = knowledge.build(pages, catalog, spark.createDataFrame([("extends", ["builds upon"])], "relation string, phrases array<string>"))
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("cut-*")) - before]
    assert sum("text" in c for c in left) == 1 and len(left) == 2
    assert {(r.document_id, r.text) for r in k.chunks.collect()} == {("t", "Adam builds upon SGD."), ("u", "Another text.")}  # each page's own
    assert k.chunk_edges.count() == 0 and [r.item for r in k.rejected.collect()] == ["2"]


def test_build_shuffles_no_text_or_vector_twice(spark, monkeypatch):
    import os
    import re
    import time

    from pyspark.sql import DataFrameWriter

    shuffles = lambda: sum(f.startswith("shuffle_") for p in spark.sparkContext._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark._jsc.sc().conf()) for _, _, fs in os.walk(p) for f in fs)
    rows = [(i, "t", "s", f"<html><body><div class='toc'>x</div><p>Adam builds upon SGD {i}.</p></body></html>") for i in [*range(20), 3]]
    pages = spark.createDataFrame(rows, "page_id long, topic_id string, source_id string, html string")
    catalog = spark.createDataFrame([(1, "adam", "m", None), (2, "sgd", "m", None)], "entity_no int, name string, label string, aliases array<string>")
    verbs = spark.createDataFrame([("extends", ["builds upon"])], "relation string, phrases array<string>")
    written, write = [], DataFrameWriter.parquet

    def noted(self, path, *a, **k):
        before = shuffles()
        write(self, path, *a, **k)
        written.append((self._df, shuffles() - before))

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    k = knowledge.build(pages, catalog, verbs)
    monkeypatch.undo()
    assert k.chunks.count() == 20 and k.chunk_edges.count() == 190
    assert len(written) == 4 and all(left <= 0 for _, left in written)  # a table's shuffles go as soon as it is written
    plan = written[-1][0]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Exchange")  # vectors are made after the last shuffle
    scans = {re.sub(r"#\d+", "", x.split("DataFilters")[1].split("Format")[0]) for x in plan.splitlines() if "FileScan parquet [chunk_id" in x}
    assert len(scans) == 1 and plan.count("REPARTITION_BY_COL") == 2  # alike, so that the chunks are dealt once for both uses

    def embed(items, key, text):  # a provider that fails on one chunk
        return chunking.embed(items.where(~F.col(text).contains("SGD 7.")), key, text)

    k = knowledge.build(pages, catalog, verbs, knowledge.Providers(embed=embed))
    assert k.chunks.count() == 19 and [r.reason for r in k.rejected.collect()] == ["embeddings of 64 to 64"]


def test_components(spark):
    rows = [(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (None, 3), (7, 6), (7, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_a_hub_is_dealt(spark):
    rows = [(0, i) for i in range(1, 400)] + [(1000, 1001), (399, 1000)]
    got = connected_components(spark.createDataFrame(rows, "a int, b int"), "a", "b", hot_rows=20).collect()
    assert len(got) == 402 and {r.component for r in got} == {0}


def test_hot_keys_are_dealt_over_tasks(spark):
    n = 6000
    refs = spark.range(n).selectExpr("cast(id as string) edge_id", "case when id % 3 = 0 then 'hot' else concat('k', id) end as key", "timestamp_ntz'2024-01-01 00:00:00' as ref_at", "'t' as ref_table", "'c' as ref_column")
    parents = spark.range(n).selectExpr("concat('k', id) as key", "true as is_parent").unionByName(spark.createDataFrame([("hot", True)], "key string, is_parent boolean"))
    hot = skew.hot_keys(refs, "key", 100)
    assert [(r.key, r._salts) for r in hot.collect()] == [("hot", 20)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.spread_join(refs, parents, "key", F.col("edge_id"), "left", hot, "merge")
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == n and joined.where("is_parent").count() == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert skew.hot_keys(refs, "key") is None and skew.hot_keys(refs.where("false"), "key") is None
    gone = spark.createDataFrame([("hot", datetime(2023, 1, 1), None)], "chunk_id string, deleted_at timestamp_ntz, restored_at timestamp_ntz")
    chunks = spark.createDataFrame([("hot", datetime(2022, 1, 1))], "chunk_id string, created_at timestamp_ntz")
    got = R.orphan_references(refs, R.parent_validity(chunks, "chunk_id", gone), hot_rows=100).groupBy("kind").count().collect()
    assert sorted((r.kind, r["count"]) for r in got) == [("deleted", 2000), ("missing", 4000)]


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://h:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())


def test_buckets_and_versions(spark):
    b = spark.createDataFrame([(1, "one", ["p", "x"], ["s"]), (2, "two", ["s", "p"], ["x", "t"]), (3, "three", [], ["t"])], "bucket_pos int, bucket_name string, primary_concepts array<string>, secondary_concepts array<string>")
    q = spark.createDataFrame([("p",), ("x",), ("s",), ("t",), ("u",), (None,)], "primary_concept string")
    assert {r.primary_concept: r.bucket_name for r in B.add_buckets(q, b).collect()} == {"p": "two", "x": "one", "s": "two", "t": "two", "u": "Uncategorized", None: "Uncategorized"}
    v = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("m", 1, "d")], "k string, version int, id string")
    assert {r.id for r in B.latest_bank(v, ["k"], "version").collect()} == {"b", "c", "d"}
    assert {r.id for r in B.latest(v, ["k"], [F.col("version"), F.col("id")]).collect()} == {"c", "d"}
    with pytest.raises(LookupError):
        B.latest(v.where("false"), ["k"], [F.col("version")], strict=True)


def test_orphans(spark):
    t = lambda d: datetime(2024, 1, d)
    chunks = spark.createDataFrame([("A1", t(5), 1), ("A1", t(5), 1), ("b2", t(1), 2), ("c3", None, 3), (None, t(1), 4)], "chunk_id string, created_at timestamp_ntz, key int")
    gone = spark.createDataFrame([("B2 ", t(3), t(6), "x"), ("zz", t(1), None, "x"), ("c3", None, None, "x")], "chunk_id string, deleted_at timestamp_ntz, restored_at timestamp_ntz, reason string")
    rows = [("e1", " a1", t(4)), ("e2", "A1", t(5)), ("e3", "b2", t(3)), ("e4", "b2", t(6)), ("e5", "zz", t(9)), ("e6", "  ", t(1)), ("e7", None, t(1)), ("e8", "b2", None), ("e9", "c3", t(1)), ("e5", "zz", t(9))]
    edges = spark.createDataFrame([(*r, "clash") for r in rows], "edge_id string, chunk_id string, created_at timestamp_ntz, found string")
    refs = R.references(edges, "t", ["chunk_id"], "edge_id")
    got = sorted((r.edge_id, r.kind) for r in R.orphan_references(refs, R.parent_validity(chunks, "chunk_id", gone)).collect())
    assert got == [("e1", "late"), ("e3", "deleted"), ("e5", "missing")]
    report = R.orphan_report(R.orphan_references(refs, R.parent_validity(chunks, "chunk_id", gone))).collect()
    assert sum(r.orphans for r in report) == 3 and {r.month for r in report} == {"2024-01"}
    empty = R.parent_validity(chunks.where("false"), "chunk_id", gone.where("false"))
    assert R.orphan_references(refs, empty).where("kind <> 'missing'").count() == 0
    assert R.orphan_references(refs.where("false"), empty).count() == 0
