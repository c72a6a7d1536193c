"""Edges between chunks, and between questions, by shared entities or similar vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scoring as S
from loomgraph.operators.search import vector_topk

#: Chunks of a block: the least and the most; copies of a chunk on the average from which blocks are made larger, up to the most.
BLOCK, MOST, COPIES = 4096, 32768, 2.5
#: Similarities that are computed at a time.
CELLS = 2**20
#: Rows and bytes that are packed at a time.
PACKED, PACKED_BYTES = 32768, 2**25


def chunk_edges(chunks: DataFrame, scope: list[str], threshold: float = S.CHUNK_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Pairs of a scope's chunks with cosine of at least ``threshold`` or a shared entity, the smaller id first.

    A scope of more than a block of chunks is dealt into blocks by the id's hash, and every two of its blocks (and each with
    itself) meet in one task: there the entities by an inverted index, the vectors by a matrix product, CELLS pairs at a
    time. So pairs are never shuffled, and a hot scope is spread over tasks. Chunks without usable vector, or with one of
    another length, have a null similarity. A chunk is copied to all blocks of its scope, so with blocks of one size the
    shuffle would grow as the scopes' square: from ``block`` on they are doubled, eight times at most, until COPIES
    suffice on the average. Copies travel packed, the rows of a block in one compressed value. Result: source_chunk, target_chunk, shared_entities (sorted), similarity (6 places).
    """
    known = chunks.where(" and ".join(f"{c} is not null" for c in ["chunk_id", *scope]))
    sizes = [block * 2**i for i in range((MOST // BLOCK).bit_length())]
    counted = known.groupBy(*scope).agg(F.count("*").alias("n"))
    fits = [F.sum(F.col("n") * F.ceil(F.col("n") / b)) <= COPIES * F.sum("n") for b in sizes[:-1]]
    size = counted.agg(F.coalesce(*[F.when(ok, b) for ok, b in zip(fits, sizes)], F.lit(sizes[-1])).alias("size"))
    large = counted.crossJoin(F.broadcast(size)).select(*scope, F.ceil(F.col("n") / F.col("size")).cast("int").alias("blocks")).where("blocks > 1")
    own = known.select(*scope, "chunk_id", F.when(~F.exists("embeddings", lambda x: x.isNull()), S.doubles(F.col("embeddings"))).alias("v"), F.array_compact(F.array_distinct("entities.normalized_text")).alias("e"))
    rows = own.join(F.broadcast(large), scope, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    own_block = [*scope, "blocks", "_block"]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own_block]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= PACKED or sum(h.nbytes for h in held) >= PACKED_BYTES:
                yield from _packed(held, own_block)
                held = []
        yield from _packed(held, own_block)

    packed = rows.select(*own_block, "chunk_id", "v", "e").mapInArrow(pack, ", ".join([*kinds, "packed binary"]))
    met = packed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*scope, "_x", "_y"]
    met = met.select(*scope, F.least("_block", "_with").alias("_x"), F.greatest("_block", "_with").alias("_y"), "_block", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in key))
            for k, block, rows in zip(keys, b.column("_block").to_pylist(), b.column("packed")):
                if k != now:
                    yield from _block_edges(held, threshold)
                    held, now = [], k
                t = _unpack(rows.as_buffer())
                held.append(t.append_column("within", pa.repeat(k[-1] == k[-2], t.num_rows)).append_column("_block", pa.repeat(block, t.num_rows)))
        yield from _block_edges(held, threshold)

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, f"source_chunk {kind}, target_chunk {kind}, shared_entities array<string>, similarity double")


def _packed(held: list[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each key, with the chunks, vectors and entities of its rows as a compressed Arrow stream.

    Vectors of one length with few different values, as counts of words have, go as these values and their places, bit for bit.
    """
    if not sum(b.num_rows for b in held):
        return
    t = pa.Table.from_batches(held).combine_chunks()
    found = t.select(key).append_column("_at", pa.array(np.arange(t.num_rows))).group_by(key).aggregate([("_at", "list")])
    out = []
    for at in found.column("_at_list"):
        rows = t.select(["chunk_id", "v", "e"]).take(at.values).combine_chunks()
        v = rows.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        if not v.null_count and (size := len(v[0])) and pc.all(pc.equal(pc.list_value_length(v), size)).as_py():
            bits = v.flatten().to_numpy(zero_copy_only=False).view(np.int64).reshape(-1, size)
            order = np.argsort(bits, axis=1, kind="stable")
            in_order = np.take_along_axis(bits, order, 1)
            new = np.ones(bits.shape, bool)
            new[:, 1:] = in_order[:, 1:] != in_order[:, :-1]
            many = new.sum(1)
            if many.max() <= 256 and 8 * many.mean() + size < 6 * size:
                place = np.empty(bits.shape, np.uint8)
                np.put_along_axis(place, order, (np.cumsum(new, 1) - 1).astype(np.uint8), 1)
                lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(x))
                rows = rows.drop_columns("v").append_column("values", lists(in_order[new].view(np.float64), many)).append_column("places", lists(place.ravel(), np.full(len(v), size)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(rows)
        out.append(sink.getvalue())
    whole = found.select(key).append_column("packed", pa.array([memoryview(x) for x in out], pa.binary()))
    yield from whole.combine_chunks().to_batches()


def _unpack(packed: pa.Buffer) -> pa.Table:
    """The table of chunk_id, v and e that _packed() wrote."""
    t = pa.ipc.open_stream(packed).read_all().combine_chunks()
    if "v" in t.column_names:
        return t.select(["chunk_id", "e"]).add_column(1, "v", t.column("v").cast(pa.list_(pa.float64())))
    values, places = (c.chunk(0) if isinstance(c := t.column(k).combine_chunks(), pa.ChunkedArray) else c for k in ("values", "places"))
    begin = np.repeat(values.offsets.to_numpy()[:-1], pc.list_value_length(places).to_numpy())
    v = values.values.to_numpy()[begin + places.values.to_numpy()]
    return t.select(["chunk_id", "e"]).add_column(1, "v", pa.ListArray.from_arrays(places.offsets, pa.array(v)))


def _block_edges(held: list[pa.Table], threshold: float) -> Iterator[pa.RecordBatch]:
    """The edges between two blocks of a scope, or within one."""
    if not held:
        return
    t = pa.concat_tables(held).combine_chunks()
    held.clear()
    ids = t.column("chunk_id").to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    order = [o for n, o in enumerate(order) if not n or ids[o] != ids[order[n - 1]]]  # repeated rows once
    t = t.take(pa.array(order)).combine_chunks()
    ids, n = t.column("chunk_id").combine_chunks(), len(order)
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    side = t.column("_block").to_numpy()
    within = t.column("within")[0].as_py()
    # vectors by their length, read from the column's own memory
    v = t.column("v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    length, begin, values = pc.fill_null(pc.list_value_length(v), 0).to_numpy(), v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    sized = []
    for size in sorted(set(length.tolist()) - {0}):
        own = np.flatnonzero(length == size)
        m = values[begin[:-1][own][:, None] + np.arange(size)]
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m /= np.where(norm == 0, 1, norm)
        sized.append((own, m))
    del v, values
    t = t.drop_columns("v")
    # entities by their rank, as postings
    listed = t.column("e").to_pylist()
    names = sorted({x for e in listed for x in e or ()})
    rank = {x: i for i, x in enumerate(names)}
    names = pa.array(names, pa.string())
    owner = np.repeat(np.arange(n), [len(e or ()) for e in listed])
    entity = np.fromiter((rank[x] for e in listed for x in e or ()), np.int64, len(owner))
    by = np.argsort(entity, kind="stable")
    posting, first = owner[by], np.searchsorted(entity[by], np.arange(len(names) + 1))
    step = max(1, CELLS // n)
    for a in range(0, n, step):
        z = min(n, a + step)
        sims = np.full((z - a, n), np.nan)
        measured = np.zeros((z - a, n), bool)
        for own, m in sized:
            here = np.flatnonzero((own >= a) & (own < z))
            at = np.ix_(own[here] - a, own)
            with np.errstate(invalid="ignore"):
                sims[at] = np.round(m[here] @ m.T, 6) + 0.0
            measured[at] = True
        low, high = np.searchsorted(owner, [a, z])
        many = (first[1:] - first[:-1])[entity[low:high]]
        start = np.repeat(first[entity[low:high]] - np.cumsum(many) + many, many)
        other = posting[start + np.arange(len(start))]
        code, shared = np.repeat(owner[low:high] - a, many) * n + other, np.repeat(entity[low:high], many)
        code, shared = (x[(other > np.repeat(owner[low:high], many))] for x in (code, shared))
        by = np.lexsort((shared, code))
        code, shared = code[by], shared[by]
        with np.errstate(invalid="ignore"):
            kept = sims >= threshold
        kept.ravel()[code] = True
        kept &= np.arange(n)[None, :] > np.arange(a, z)[:, None]
        if not within:
            kept &= side[None, :] != side[a:z, None]
        i, j = np.nonzero(kept)
        if not len(i):
            continue
        at = i * n + j
        starts, ends = np.searchsorted(code, at), np.searchsorted(code, at, "right")
        wanted = kept.ravel()[code]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends - starts)]), pa.int32()), names.take(pa.array(shared[wanted])))
        yield pa.record_batch([ids.take(pa.array(i + a)), ids.take(pa.array(j)), lists, pa.array(sims[i, j], mask=~measured[i, j])], ["source_chunk", "target_chunk", "shared_entities", "similarity"])


def semantic_neighbours(questions: DataFrame, threshold: float = S.QUESTION_SIMILARITY) -> DataFrame:
    """Each question with its neighbours of the same scope: cosine of at least ``threshold`` before rounding to 3 places.

    questions: question_id, scope, v. Questions without neighbours keep an empty list; neighbours are sorted by
    similarity, then id.
    """
    q, i = questions.withColumnRenamed("question_id", "query_id"), questions.withColumnRenamed("question_id", "item_id")
    hits = vector_topk(q, i, k=None, scope=True, floor=threshold)
    listed = hits.groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct((-F.round("vector_score", 3)).alias("neg"), F.col("item_id").alias("id")))).alias("n"))
    shaped = F.transform(F.coalesce("n", F.array()), lambda x: F.named_struct(F.lit("question_id"), x.id, F.lit("similarity"), -x.neg))
    return questions.select("question_id").distinct().join(listed, "question_id", "left").select("question_id", F.when(F.col("n").isNull(), F.expr("cast(array() as array<struct<question_id:string,similarity:double>>)")).otherwise(shaped).alias("semantic_neighbours"))


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every edge in both directions, as node and neighbour with the other columns."""
    rest = [c for c in edges.columns if c not in (a, b)]
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), *rest)
    return one.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("neighbour"), *rest))


def expand(seeds: DataFrame, edges: DataFrame, n: int = S.EXPANDED) -> DataFrame:
    """The n best neighbours of the seeds, per query: similarity x the seed's score, at least 0, the best over the seeds.

    seeds: query_id, item_id, score; edges: source_chunk, target_chunk, similarity, read in both directions.
    Seeds themselves are left out; edges of null similarity count 0. Ties go to the smaller id.
    """
    from loomgraph.operators.search import ranked

    both = symmetric(edges.select("source_chunk", "target_chunk", "similarity"), "source_chunk", "target_chunk").where("neighbour is not null")
    reached = seeds.join(both, seeds.item_id == both.node).select("query_id", F.col("neighbour").alias("item_id"), (F.coalesce("similarity", F.lit(0.0)) * F.col("score")).alias("s"))
    best = reached.groupBy("query_id", "item_id").agg(F.round(F.greatest(F.max("s"), F.lit(0.0)), 6).alias("expansion_score"))
    fresh = best.join(seeds.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    return ranked(fresh, "expansion_score", "expansion_rank", n)
