"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.encoding import TOKENIZERS, token_counts
from loomgraph.runtime import materialize

#: Rows of a source that are numbered in one task, and blocks that are scheduled in one.
RUN, FRAME = 20_000, 50_000


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The order in which the sources' blocks are served: at any slot no source is a whole block off its weight.

    Block j of a source of weight w (its share of all blocks) is released at floor(j / w) and due at ceil((j + 1) / w);
    of the released blocks the one due first is served, ties by source name.
    """
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s, n in sorted(blocks.items()) if n > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            due = -(-(j + 1) * total // blocks[s])
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // blocks[s], s, j + 1))
    return out


def frames(blocks: dict[str, int], frame: int = FRAME) -> list[tuple[int, dict[str, int], dict[str, int]]]:
    """(first slot, blocks served before, blocks to serve) of each run of at most ``frame`` slots: at its end every source has
    its weight of the slots, rounded down or up."""
    total = sum(blocks.values())
    before = dict.fromkeys(blocks, 0)
    out = []
    for start in range(0, total, frame):
        end = min(start + frame, total)
        done = {s: max(before[s], n * end // total) for s, n in blocks.items()}
        ahead = sorted(blocks, key=lambda s: (Fraction(blocks[s] * end, total) - done[s], s), reverse=True)
        rest = end - sum(done.values())
        for s in ahead[:rest] if rest > 0 else [s for s in reversed(ahead) if done[s] > before[s]][:-rest]:
            done[s] += 1 if rest > 0 else -1
        out.append((start, before, {s: done[s] - before[s] for s in blocks}))
        before = done
    return out


def schedule(spark: SparkSession, blocks: dict[str, int], frame: int = FRAME) -> DataFrame:
    """(source, block_no, slot) of all blocks, by ``pfair`` within each frame; frames are scheduled by the executors."""
    listed = list(blocks)
    rows = [(start, [before[s] for s in listed], [own[s] for s in listed]) for start, before, own in frames(blocks, frame)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, before, own in zip(b["start"], b["before"], b["own"]):
                base = dict(zip(listed, before))
                out = pfair({s: int(n) for s, n in zip(listed, own)})
                yield pd.DataFrame({"source": [s for s, _ in out], "block_no": [base[s] + j for s, j in out], "slot": range(start, start + len(out))})

    table = spark.createDataFrame(rows, "start long, before array<long>, own array<long>")
    return table.repartition(max(1, min(len(rows), 10_000))).mapInPandas(run, "source string, block_no long, slot long")


def sized(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, folder: str, name: str, size: Column | None = None) -> DataFrame:
    """(key, source, n_tokens) of the targets' documents, repeated rows once; ``size`` stands for the number of tokens if given."""
    wanted = F.broadcast(targets.select("source").distinct())
    given = F.lit(None).cast("long") if size is None else size.cast("long")
    docs = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.col(source).alias("source"), given.alias("n_tokens")).join(wanted, "source").where("doc is not null")
    if size is not None:
        return docs.select("doc", "source", "n_tokens").distinct().where("n_tokens > 0")
    return token_counts(docs, ["doc", "source"], "text", folder, name).distinct().where("n_tokens > 0")


def mix(
    documents: DataFrame, targets: DataFrame, key: str, text: str = "text", source: str = "source", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", block_tokens: int = 4096, most_sources: int = 10_000, seed: int = 1, size: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): the documents in the order of the mixture, and what was reached.

    The total is the size in tokens (or ``size``) of all documents of the listed sources; each source fills its target_share of it,
    with its documents in a random but fixed order, again from the start up to max_repeats times. A source too small
    for that gives all it may; the others are not stretched to make up for it. Each source's stream is cut into blocks of
    ``block_tokens`` tokens and Pfair scheduling interleaves them, so that every prefix of the mixture has each source
    within one block (two, beyond FRAME blocks), and its largest document, of its weight. The schedule depends on the
    numbers of blocks only; it is made frame by frame on the executors.

    Documents are numbered by two-level prefix sums over hash ranges of at most about RUN rows, so no source is
    gathered in one task. Targets are few (checked: at most ``most_sources``), and broadcast.

    Defined cases: documents of null or unlisted sources and those without tokens (null or empty text) take no part;
    targets with null source, null or non-positive share, or max_repeats below 1 are left out, a null max_repeats
    is 1; a source listed twice raises; a listed source without documents is reported with 0; empty input gives an empty
    mixture. Mixture: key, source, repeat_no, slot, place (tokens of the source before it), n_tokens; the order is
    (slot, place). Shares: source, target_share, reached_share (of the total), mixture_share (of what was mixed),
    target_tokens, available_tokens, mixed_tokens, documents, copies, most_copies.
    """
    spark = documents.sparkSession
    goal = targets.select("source", F.col("target_share").cast("double"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats")).distinct()
    goal = goal.where("source is not null and target_share > 0 and max_repeats >= 1").orderBy("source").limit(most_sources + 1)
    rows = goal.collect()
    wanted = {r[0]: (r[1], r[2]) for r in rows}
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    if len(wanted) < len(rows):
        raise ValueError("a source has two targets")
    listed = spark.createDataFrame([(s,) for s in wanted], "source string")
    sizes = materialize(sized(documents, listed, key, text, source, folder, name, size))
    have = {r[0]: (int(r[1]), int(r[2])) for r in sizes.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    total = sum(t for t, _ in have.values())
    plan = {}
    for s, (share, repeats) in wanted.items():
        tokens, count = have.get(s, (0, 0))
        quota = min(round(Fraction(share) * total), tokens * repeats)
        plan[s] = (quota, tokens, repeats, -(-count // RUN) or 1)
    block = max(1, block_tokens)
    counts = {s: -(-q // block) for s, (q, *_) in plan.items() if q > 0}
    order = schedule(spark, counts)
    limits = F.broadcast(spark.createDataFrame([(s, q, t, n, counts.get(s, 0), -(-q // t) if t else 0) for s, (q, t, _, n) in plan.items()], "source string, quota long, tokens long, runs long, blocks long, passes long"))

    # place of every document in its source: the run's offset and the sum within the run
    h = F.xxhash64(F.col("doc").cast("string"), F.lit(seed))
    placed = sizes.join(limits, "source").withColumn("h", h).withColumn("run", F.pmod("h", F.col("runs")))
    runs = placed.groupBy("source", "run").agg(F.sum("n_tokens").alias("run_tokens"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("source", "run", F.coalesce(F.sum("run_tokens").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "run").orderBy("h", "doc", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.withColumn("local", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offsets, ["source", "run"]).withColumn("start", F.col("offset") + F.col("local"))
    copies = start.where("passes > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))).withColumn("place", F.col("start") + F.col("repeat_no") * F.col("tokens"))
    # a document belongs to the quota when its middle does
    taken = copies.where(F.col("place") * 2 + F.col("n_tokens") <= F.col("quota") * 2).withColumn("block_no", F.least(F.floor(F.col("place") / block), F.col("blocks") - 1))
    mixture = taken.join(order, ["source", "block_no"]).select(F.col("doc").alias(key), "source", F.col("repeat_no").cast("int").alias("repeat_no"), "slot", "place", "n_tokens")

    got = mixture.groupBy("source", key).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).groupBy("source").agg(F.sum("t").alias("mixed"), F.count("*").alias("documents"), F.sum("n").alias("copies"), F.max("n").alias("most"))
    wish = spark.createDataFrame([(s, float(wanted[s][0]), round(Fraction(wanted[s][0]) * total), plan[s][1] * plan[s][2]) for s in wanted], "source string, target_share double, target_tokens long, available_tokens long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_mixed = F.sum(zero("mixed")).over(Window.partitionBy())
    shares = wish.join(got, "source", "left").select(
        "source", "target_share", (zero("mixed") / F.lit(max(total, 1))).alias("reached_share"), F.coalesce(F.try_divide(zero("mixed"), all_mixed), F.lit(0.0)).alias("mixture_share"), "target_tokens", "available_tokens",
        zero("mixed").alias("mixed_tokens"), zero("documents").alias("documents"), zero("copies").alias("copies"), zero("most").alias("most_copies"),
    )
    return mixture, shares
