"""Top N items within every group, by score histograms of the large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import materialize

#: A histogram cell is one of BINS score ranges, split SPLIT ways by a hash of the tie key.
BINS, SPLIT = 256, 16


def top_n(items: DataFrame, group: str, score: str, tie: str, n: int = 5, least_rows: int = 4096, most_groups: int = 20_000) -> DataFrame:
    """The n items of highest score in every group; on equal scores those with the smaller tie key.

    1. Groups are counted (partial aggregation before the shuffle). Groups of more than ``least_rows`` rows, and never
       more than ``most_groups`` of them (the limit rises with the number of rows), get a histogram.
    2. A cell of a group's histogram is a score bin within which the tie key hashes alike. Repeated rows share their
       cell, so the best items of two cells differ, and the n-th best of all cells' best items is a lower threshold
       that at least n different items reach, ties included. The bins run over the group's own score range.
    3. Large groups lose the rows below their threshold at the scan (the thresholds are a broadcast of at most
       ``most_groups`` rows), so no hot group reaches the shuffle; what is left is ranked exactly.

    Defined cases: rows whose group, score or tie key is null, or whose score is NaN, take no part; infinite scores do.
    Repeated rows (same group, score, tie key) count once. Groups of fewer than n items come out whole. An empty input
    gives an empty result. Other columns are not read, so their names cannot clash. Result: group, tie, score, rank.
    """
    rows = items.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(tie).alias("t")).where("g is not null and s is not null and not isnan(s) and t is not null")
    by = [F.col("s").desc(), F.col("t").asc()]
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")))
    total = sizes.agg(F.sum("c")).first()[0] or 0
    least = max(least_rows, total // most_groups)
    kept = rows
    if total > least:
        large = F.broadcast(sizes.where(F.col("c") > least).select("g", "lo", "hi"))
        width = F.col("hi") - F.col("lo")
        at = F.when((width > 0) & (width < float("inf")), F.floor((F.col("s") - F.col("lo")) / width * (BINS - 1))).otherwise(0)
        cells = (
            rows.join(large, "g").withColumn("bin", at).withColumn("part", F.pmod(F.xxhash64("t"), F.lit(SPLIT)))
            .groupBy("g", "bin", "part").agg(F.min(F.struct((-F.col("s")).alias("neg"), F.col("t"))).alias("best"))
        )
        nth = cells.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("best"))).where(F.col("r") == n)
        limits = F.broadcast(nth.select("g", F.col("best").alias("limit")))
        mine = F.struct((-F.col("s")).alias("neg"), F.col("t"))
        kept = rows.join(limits, "g", "left").where(F.col("limit").isNull() | (mine <= F.col("limit"))).select("g", "s", "t")
    # dense_rank leaves repeated rows on one rank; Catalyst limits each group before the shuffle as well
    ranked = kept.withColumn("rank", F.dense_rank().over(Window.partitionBy("g").orderBy(*by))).where(F.col("rank") <= n)
    return ranked.distinct().select(F.col("g").alias(group), F.col("t").alias(tie), F.col("s").alias(score), "rank")
