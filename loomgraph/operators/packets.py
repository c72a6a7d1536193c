"""Topic packets as texts: a topic's rows pass its task once, in order, and only the texts themselves are held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rendering as X
from loomgraph.operators import graph as G
from loomgraph.runtime import materialize

#: Kinds of rows, in the order in which they are read.
TOPIC, CORE, TEXTS, RETRIEVED, RELATED, TWO, THREE = range(7)


def packet_rows(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """What the packets are made of, as (topic_id, kind, a, b, n, line); every topic has a row at least.

    a: the concept, text, equation or first node; b: an equation's intuition or a path's quality; n: a path's rank; line:
    the path as text. Repeated concepts, texts and equations may be there. chunks: document_id, chunk_id, text, entities.
    """
    c = materialize(G.topic_chunks(chunks))
    none = F.lit(None).cast("string")

    def rows(kind: int, df: DataFrame, a=none, b=F.lit(""), n=F.lit(0), line=none) -> DataFrame:
        return df.select("topic_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), n.cast("int").alias("n"), line.alias("line"))

    out = rows(TOPIC, c.select("topic_id").distinct())
    out = out.unionByName(rows(CORE, G.topic_names(c), F.col("name"))).unionByName(rows(TEXTS, c.where("text is not null"), F.col("text")))
    for kind, df in zip((RETRIEVED, RELATED), G.topic_equations(c, edges)):
        out = out.unionByName(rows(kind, df, F.col("target"), F.col("source")))
    graph = materialize(G.undirected(G.topic_graph(c, edges), ("topic_id",)))
    for kind, found in zip((TWO, THREE), G.topic_paths(graph).values()):
        steps = G.path_steps(found, graph, ("topic_id",))
        out = out.unionByName(rows(kind, steps, F.col("entity"), F.col("quality"), F.col("path_rank"), X.render_path(F.col("quality"), F.col("path_score"), F.col("path"))))
    return out


def gathered(rows: DataFrame, separators: dict[int, str], finish: Callable[[dict[int, bytearray]], Iterator[list[list[bytes]]]], columns: list[str]) -> DataFrame:
    """packet_rows() as one or more rows of texts per topic: topic_id and the columns.

    The rows of a topic come sorted, so a repeated one stands beside the first, and each kind grows as one text with its
    separator; equations are rendered here, so that their texts are shuffled once. ``finish`` gets the texts by kind and
    yields the columns of each row as pieces; a text is bounded by the 2 GB that a value may have. Half of the cores build
    packets, as one is held in several copies on its way to the table: two large ones at a time are more than an executor has.
    """
    sep = {k: v.encode() for k, v in separators.items()}
    empty = pa.record_batch([pa.array([], pa.string())] * (1 + len(columns)), ["topic_id", *columns])

    def batch(topic: str, pieces: list[list[bytes]]) -> pa.RecordBatch:
        made = []
        for p in [[topic.encode()], *pieces]:
            data = p[0] if len(p) == 1 else b"".join(p)
            made.append(pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)]))
        return pa.record_batch(made, ["topic_id", *columns])

    def emit(topic: str, parts: dict[int, bytearray]) -> Iterator[pa.RecordBatch]:
        for pieces in finish(parts):
            made = batch(topic, pieces)
            pieces.clear()
            yield made
            made = None
            yield empty  # the one before is let go only when another follows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, last = None, {}, None
        for x in batches:
            if not x.num_rows:
                continue
            code = pc.dictionary_encode(x.column("topic_id")).indices.to_numpy() * len(sep) * 2 + x.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for i, j in zip(cuts, cuts[1:]):
                topic, kind = x.column("topic_id")[i].as_py(), x.column("kind")[i].as_py()
                if topic != now:
                    if now is not None:
                        yield from emit(now, parts)
                    now, parts, last = topic, {}, None
                if kind == TOPIC:
                    continue
                a, b, values = (x.column(k).slice(i, j - i) for k in ("a", "b", "line"))
                if kind < TWO:
                    new = np.ones(j - i, bool)
                    new[1:] = pc.or_(pc.not_equal(a[1:], a[:-1]), pc.not_equal(b[1:], b[:-1])).to_numpy(zero_copy_only=False)
                    new[0] = last != (kind, a[0].as_py(), b[0].as_py())
                    last = kind, a[-1].as_py(), b[-1].as_py()
                    a, b = (v.filter(pa.array(new)) for v in (a, b))
                    values = a if kind < RETRIEVED else pc.binary_join_element_wise("[EQ] ", a, " \n INTUITION: ", b, "")
                if len(values):
                    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), sep[kind].decode())[0].as_buffer()
                    if kind in parts:
                        parts[kind] += sep[kind]
                        parts[kind] += text
                    else:
                        parts[kind] = bytearray(text)
        if now is not None:
            yield from emit(now, parts)

    ordered = rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism // 2), "topic_id").sortWithinPartitions("topic_id", "kind", "a", "b", "n")
    return ordered.mapInArrow(run, ", ".join(f"{c} string" for c in ["topic_id", *columns]))


def packet_texts(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per topic: concepts and texts joined, paths and equations as in the prompts."""

    def finish(p: dict[int, bytearray]) -> Iterator[list[list[bytes]]]:
        yield [[p.pop(k, b"")] for k in (CORE, TEXTS, TWO, THREE)] + [[p.pop(k, b"None")] for k in (RETRIEVED, RELATED)]

    separators = {CORE: " | ", TEXTS: " | ", RETRIEVED: "\n", RELATED: "\n", TWO: "\n", THREE: "\n"}
    return gathered(packet_rows(chunks, edges), separators, finish, ["core_concepts", "supporting_chunks", "concept_paths_2_hop", "concept_paths_3_hop", "retrieved_equations", "related_equations"])


def contexts(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per topic and difficulty: its context as rendering.render_context() makes it."""

    def finish(p: dict[int, bytearray]) -> Iterator[list[list[bytes]]]:
        listed = lambda k: [b"['", p.pop(k), b"']"] if k in p else [b"[]"]
        common = [b"## Available Entities\n", *listed(CORE), b"\n\n## Supporting Knowledge\n", *listed(TEXTS), b"\n"]
        for difficulty, paths, equations, a, b in ((b"medium", TWO, RETRIEVED, b"## Concept Paths (2-Hop)", b"## Retrieved Equations"), (b"hard", THREE, RELATED, b"## Concept Paths (3-Hop)", b"## Related Equations")):
            yield [[difficulty], [*common, b"\n", a, b"\n", p.pop(paths, b""), b"\n\n", b, b"\n", p.pop(equations, b"None"), b"\n"]]
        yield [[b"easy"], common]

    separators = {CORE: "', '", TEXTS: "', '", RETRIEVED: "\n", RELATED: "\n", TWO: "\n", THREE: "\n"}
    return gathered(packet_rows(chunks, edges), separators, finish, ["difficulty", "context"])
