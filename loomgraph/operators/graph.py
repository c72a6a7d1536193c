"""Entity and chunk graphs: nodes, neighbours, paths of two and three edges, topic packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scoring as S
from loomgraph.operators.edges import symmetric
from loomgraph.runtime import materialize


def undirected(edges: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """(node, neighbour, weight, semantic, relation), within ``per``: one edge per unordered pair of different ends, the heaviest; both directions.

    An edge is semantic and has the relation that the row kept has; ties go to semantic rows, then to the later relation. Null, blank and non-finite values are dropped.
    """
    a, b = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    rows = edges.where("source <> target and trim(source) <> '' and trim(target) <> '' and weight between 0 and 1 and not isnan(weight)")
    best = rows.groupBy(*per, a, b).agg(F.max(F.struct("weight", (F.col("edge_type") == "semantic").alias("semantic"), "relation")).alias("m"))
    return symmetric(best.select(*per, "a", "b", "m.weight", F.coalesce("m.semantic", F.lit(False)).alias("semantic"), "m.relation"), "a", "b")


def top_neighbours(edges: DataFrame, n: int = S.NEIGHBOURS) -> DataFrame:
    """The n heaviest neighbours of every node (from undirected()); ties go to the smaller name."""
    by = Window.partitionBy("node").orderBy(F.col("weight").desc(), "neighbour")
    return edges.withColumn("neighbour_rank", F.row_number().over(by)).where(F.col("neighbour_rank") <= n)


def last_edges(edges: DataFrame, order: list) -> DataFrame:
    """The last row of every unordered pair in the given order, as a simple graph keeps it."""
    by = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy(*[c.desc() for c in order])
    return edges.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _contenders(rows: DataFrame, by: list[str], weights: list[str], n: Column, slack: float, count: str, sure: Column | None = None) -> DataFrame:
    """The rows of each group that fewer than n others (of the ``sure`` ones) surely precede, whatever edge comes before them.

    A row surely precedes another whose score is lower by more than ``slack``, or one of the same weights and a later text;
    in between rounding decides, so such rows stay. Adds ``count``: the sure rows of the group up to this one.
    """
    one = (F.lit(True) if sure is None else sure).cast("int")
    group, alike = Window.partitionBy(*by), Window.partitionBy(*by, "_neg", *weights)
    past = lambda w, *order: F.sum(one).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.withColumn(count, past(group, "_neg", *weights, "_text")).withColumn("_alike", past(alike, "_text") - one)
    cut = counted.withColumn("_cut", F.min(F.when((one == 1) & (F.col(count) >= n), F.col("_neg"))).over(group))
    return cut.where((F.col("_cut").isNull() | (F.col("_neg") <= F.col("_cut") + slack)) & (F.col("_alike") < n)).drop("_alike", "_cut")


def paths(edges: DataFrame, hops: int, least: float = S.PATH_SCORE, strong: int = 5, weak: int = 3, per: tuple[str, ...] = ()) -> DataFrame:
    """Simple paths of ``hops`` edges from every node, the ``strong`` best of strong ones and the ``weak`` best of weak ones.

    A path's score is the product of its weights, and it is strong when all its edges are semantic. Products only fall,
    so paths below ``least`` are dropped after every hop. Exact, though hubs don't multiply: a last edge counts only if
    it is among the limit + hops - 1 heaviest of its node and kind, as the path holds hops - 1 nodes it can't go to. Of
    the two last edges of longer paths, those with one middle or one end count up to cap = limit + hops - 2, and of all
    from a node limit + 2 * (hops - 2) * cap, since the nodes before them bar no more than that. The work is linear in
    the edges up to three hops. With ``per``, each of its graphs is taken alone.
    Result: per, entity, quality, path_rank, path_score (6 places), nodes (as text), path (the nodes).
    """
    slack, before = 1.1e-6 / least if least > 0 else float("inf"), hops - 2
    limit = lambda s: F.when(F.col(s), max(strong, weak)).otherwise(weak)
    e = edges.where(F.col("weight") >= least).select(*per, F.col("node").alias("_from"), F.col("neighbour").alias("_to"), F.col("weight").alias("_w"), F.col("semantic").alias("_s"))
    last = _contenders(e.withColumns({"_neg": -F.col("_w"), "_text": F.col("_to")}), [*per, "_from", "_s"], ["_w"], limit("_s") + (hops - 1), slack, "_n").select(*per, "_from", "_to", "_w", "_s")
    if hops == 1:
        walk = last.select(*per, F.col("_from").alias("entity"), F.col("_w").alias("score"), F.col("_s").alias("all_semantic"), F.array("_from", "_to").alias("nodes"))
    else:
        first = e.select(*per, "_from", F.col("_to").alias("_mid"), F.col("_w").alias("_w1"), F.col("_s").alias("_s1"))
        tail = first.join(last.select(*per, F.col("_from").alias("_mid"), "_to", F.col("_w").alias("_w2"), F.col("_s").alias("_s2")), [*per, "_mid"]).where("_from <> _to")
        tail = tail.withColumns({"_neg": -F.col("_w1") * F.col("_w2"), "_s": F.col("_s1") & F.col("_s2")}).where(F.col("_neg") <= -least).drop("_s1", "_s2")
        if hops == 2:
            walk = tail.select(*per, F.col("_from").alias("entity"), (-F.col("_neg")).alias("score"), F.col("_s").alias("all_semantic"), F.array("_from", "_mid", "_to").alias("nodes"))
        else:
            cap, weights = limit("_s") + before, ["_w1", "_w2"]
            tail = tail.withColumn("_text", F.concat_ws(" > ", "_mid", "_to")).repartition(*per, "_from")
            tail = _contenders(_contenders(tail, [*per, "_from", "_s", "_mid"], weights, cap, slack, "_n1"), [*per, "_from", "_s", "_to"], weights, cap, slack, "_n2")
            sure = (F.col("_n1") <= cap) & (F.col("_n2") <= cap)
            tail = _contenders(tail, [*per, "_from", "_s"], weights, limit("_s") + 2 * before * cap, slack, "_n", sure).select(*per, F.col("_from").alias("end"), "_mid", "_to", "_w1", "_w2", "_s")
            walk = e.select(*per, F.col("_from").alias("entity"), F.col("_to").alias("end"), F.col("_w").alias("score"), F.col("_s").alias("all_semantic"), F.array("_from", "_to").alias("nodes"))
            step = e.select(*per, F.col("_from").alias("end"), "_to", F.col("_w").alias("_w1"), "_s")
            for _ in range(before - 1):
                longer = walk.join(step, [*per, "end"]).where(~F.array_contains("nodes", F.col("_to")))
                walk = longer.select(*per, "entity", F.col("_to").alias("end"), (F.col("score") * F.col("_w1")).alias("score"), (F.col("all_semantic") & F.col("_s")).alias("all_semantic"), F.concat("nodes", F.array("_to")).alias("nodes")).where(F.col("score") >= least)
            whole = walk.join(tail, [*per, "end"]).where(~F.array_contains("nodes", F.col("_mid")) & ~F.array_contains("nodes", F.col("_to")))
            walk = whole.select(*per, "entity", (F.col("score") * F.col("_w1") * F.col("_w2")).alias("score"), (F.col("all_semantic") & F.col("_s")).alias("all_semantic"), F.concat("nodes", F.array("_mid", "_to")).alias("nodes")).where(F.col("score") >= least)
    scored = walk.select(*per, "entity", F.when(F.col("all_semantic"), "strong").otherwise("weak").alias("quality"), F.round("score", 6).alias("path_score"), F.array_join("nodes", " > ").alias("nodes"), F.col("nodes").alias("path"))
    by = Window.partitionBy(*per, "entity", "quality").orderBy(F.col("path_score").desc(), "nodes")
    most = scored.withColumn("path_rank", F.row_number().over(by)).where(F.col("path_rank") <= max(strong, weak))
    return most.where(F.col("path_rank") <= F.when(F.col("quality") == "strong", strong).otherwise(weak))


def path_steps(found: DataFrame, edges: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """paths() with the path as structs (source, relation, target), the relations from undirected(); unknown ones are empty."""
    key = [*per, "entity", "quality", "path_rank"]
    steps = found.select(*key, "path_score", F.posexplode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("node"), F.expr("slice(path, 2, size(path) - 1)").alias("neighbour")))).select(*key, "path_score", "pos", "col.node", "col.neighbour")
    known = steps.join(edges.select(*per, "node", "neighbour", F.coalesce("relation", F.lit("")).alias("relation")), [*per, "node", "neighbour"])
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("node").alias("source"), "relation", F.col("neighbour").alias("target"))))
    return known.groupBy(*key, "path_score").agg(F.transform(listed, lambda x: F.struct(x.source.alias("source"), x.relation.alias("relation"), x.target.alias("target"))).alias("path"))


def equation_links(chunks: DataFrame, edges: DataFrame, per: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(mentions, related), within ``per``: chunks with each equation they mention, and co-occurring ends of equations.

    Both as source, target: the text that gives the intuition, and the equation.
    """
    eqs = chunks.select(*per, "chunk_id", F.explode("entities").alias("e")).where("e.label = 'equation' and e.normalized_text is not null").select(*per, "chunk_id", F.col("e.normalized_text").alias("equation")).distinct()
    mentions = eqs.select(*per, F.col("chunk_id").alias("source"), F.col("equation").alias("target"))
    both = symmetric(edges.where("relation = 'co_occurs'").select(*per, "source", "target").distinct(), "source", "target")
    related = both.join(eqs.select(*per, F.col("equation").alias("neighbour")).distinct(), [*per, "neighbour"], "left_semi").select(*per, F.col("node").alias("source"), F.col("neighbour").alias("target")).distinct()
    return mentions, related


def chunk_graph_nodes(edges: DataFrame) -> DataFrame:
    """(chunk_id, degree) of every end of a chunk edge."""
    ends = symmetric(edges.select("source_chunk", "target_chunk"), "source_chunk", "target_chunk")
    return ends.where("node is not null").groupBy(F.col("node").alias("chunk_id")).agg(F.count("*").alias("degree"))


def chunk_graph_edges(edges: DataFrame) -> DataFrame:
    """Edges with their weight and number of shared entities, under a key made of the ends."""
    key = F.sha2(F.concat_ws("\x01", "source_chunk", "target_chunk"), 256)
    return edges.groupBy("source_chunk", "target_chunk").agg(F.max("similarity").alias("weight"), F.max(F.size(F.coalesce("shared_entities", F.array().cast("array<string>")))).alias("shared_entities")).withColumn("edge_key", key)


def entity_graph_edges(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Relation edges, and 'mentions' edges of weight 0.5 from every chunk to its entities."""
    mentions = chunks.select(F.col("chunk_id").alias("source"), F.explode("entities.normalized_text").alias("target")).where("target is not null").distinct()
    mentions = mentions.select("source", F.lit("mentions").alias("relation"), "target", F.lit(0.5).alias("weight"))
    return mentions.unionByName(edges.select("source", "relation", "target", "weight").distinct())


def topic_graph(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of each topic's chunks whose ends are both entities of these chunks: two semi-joins. chunks: topic_id."""
    names = chunks.select("topic_id", F.explode("entities.normalized_text").alias("name")).where("name is not null").distinct()
    end = lambda c: names.withColumnRenamed("name", c)
    own = edges.join(chunks.select("topic_id", "chunk_id").distinct(), "chunk_id")
    return own.join(end("source"), ["topic_id", "source"], "left_semi").join(end("target"), ["topic_id", "target"], "left_semi")


def topic_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """The chunks that have a topic: topic_id, chunk_id and the columns, text and entities if none are named."""
    return chunks.where("document_id is not null").select(F.col("document_id").alias("topic_id"), "chunk_id", *(columns or ("text", "entities")))


def topic_names(chunks: DataFrame) -> DataFrame:
    """(topic_id, name): the distinct entities of each topic's chunks."""
    return chunks.select("topic_id", F.explode("entities.normalized_text").alias("name")).where("name is not null").distinct()


def topic_paths(graph: DataFrame) -> dict[str, DataFrame]:
    """The best paths of two edges and of three in each topic's graph, written, as they are read several times."""
    return {name: materialize(paths(graph, hops, strong=strong, weak=weak, per=("topic_id",))) for name, hops, strong, weak in (("2_hop", 2, 5, 3), ("3_hop", 3, 3, 2))}


def topic_equations(chunks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(retrieved, related) as topic_id, source, target: the texts that mention each equation, and the co-occurring ends of
    the topic's relations. A text comes from its own row, without a join; repeated rows may be there."""
    known = chunks.select("topic_id", F.coalesce("text", F.lit("")).alias("source"), F.explode("entities").alias("e")).where("e.label = 'equation' and e.normalized_text is not null")
    related = equation_links(chunks, edges.where("relation = 'co_occurs'").join(chunks.select("topic_id", "chunk_id"), "chunk_id"), ("topic_id",))[1]
    return known.select("topic_id", "source", F.col("e.normalized_text").alias("target")), related.select("topic_id", F.coalesce("source", F.lit("")).alias("source"), "target")


def topic_packets(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per topic: its distinct entities and chunk texts, the best paths in the graph of its own chunks and
    entities, its equations with the texts that mention them, and the co-occurring ends of its chunks' relations.

    Distinct values are made before they are collected, so what is gathered is the packet itself;
    what is read several times is written first, which keeps the plan small.
    Result: topic_id, core_concepts, supporting_chunks, concept_paths (2_hop, 3_hop), retrieved_equations, related_equations.
    """
    per = ("topic_id",)
    c = materialize(topic_chunks(chunks))
    whole = c.select("topic_id").distinct()
    names = c.select("topic_id", F.explode("entities.normalized_text").alias("x"))
    texts = c.select("topic_id", F.col("text").alias("x"))
    for name, values in (("core_concepts", names), ("supporting_chunks", texts)):
        whole = whole.join(values.where("x is not null").distinct().groupBy("topic_id").agg(F.array_sort(F.collect_list("x")).alias(name)), "topic_id", "left")
    graph = materialize(undirected(topic_graph(c, edges), per))
    for name, found in topic_paths(graph).items():
        steps = path_steps(found, graph, per)
        listed = F.array_sort(F.collect_list(F.struct("entity", F.col("quality").alias("path_quality"), "path_rank", "path_score", "path")))
        whole = whole.join(steps.groupBy("topic_id").agg(listed.alias(name)), "topic_id", "left")
    retrieved, related = topic_equations(c, edges)
    for name, rows in (("retrieved_equations", retrieved), ("related_equations", related)):
        listed = rows.distinct().groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("target", "source"))).alias("n"))
        pairs = F.transform("n", lambda x: F.struct(x.source.alias("source"), x.target.alias("target")))
        whole = whole.join(listed.select("topic_id", pairs.alias(name)), "topic_id", "left")
    filled = {k: F.coalesce(F.col(k), F.array().cast(whole.schema[k].dataType)) for k in whole.columns if k != "topic_id"}
    return whole.withColumns(filled).withColumn("concept_paths", F.struct("2_hop", "3_hop")).drop("2_hop", "3_hop")
