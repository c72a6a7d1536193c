"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import HOT, hot_keys, spread_join
from loomgraph.runtime import drop_materialized, materialize


def connected_components(edges: DataFrame, a: str, b: str, hot_rows: int = HOT) -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Alternating large-star and small-star rounds: each is one shuffle of the edges, the edges never grow beyond the
    input's number, and their number of rounds grows with the logarithm of the longest chain; every round lowers a
    node's link or is the last. Both stars are joins of the edges with each node's minimum (a partial aggregate); the edges
    of a hub with more than ``hot_rows`` are dealt over several tasks.
    Lineage is cut every round by a table in the shared folder. Nulls and self-loops are dropped; an empty input gives
    an empty result.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u are linked to the least of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.where("v > u")
        large = materialize(spread_join(up, least, "u", F.col("v"), hot=hot_keys(up, "u", hot_rows)).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours are linked to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", F.col("v"), hot=hot_keys(large, "u", hot_rows)).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.where("u <> v").distinct())
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        same = new.agg(mark, F.count("*")).first() == e.agg(mark, F.count("*")).first()
        drop_materialized(e, large)
        e = new
        if same:
            break
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
