"""References to records that do not exist: missing, deleted or late parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import HOT, hot_keys, spread_join


def reference_key(c: Column) -> Column:
    """Keys are compared without outer blanks (U+0020) and letter case."""
    return F.lower(F.trim(c))


def references(edges: DataFrame, table: str, columns: Sequence[str], id_column: str, at: str = "created_at") -> DataFrame:
    """One row per (edge, reference column) whose value is neither null nor blank.

    Only the id, the time and the reference columns are read. Result: ref_table, ref_column, edge_id, key, ref_at.
    """
    values = [F.struct(F.lit(c).alias("ref_column"), reference_key(F.col(c)).alias("key")) for c in columns]
    flat = edges.select(F.col(id_column).alias("edge_id"), F.col(at).alias("ref_at"), F.explode(F.array(*values)).alias("r"))
    return flat.select(F.lit(table).alias("ref_table"), "r.ref_column", "edge_id", "r.key", "ref_at").where(F.length("key") > 0)


def parent_validity(parents: DataFrame, key: str, deletions: DataFrame, at: str = "created_at") -> DataFrame:
    """One row per parent key: since when it exists and the intervals in which it was deleted.

    Rows: key, parent_at (latest created_at; null when never given), gone: array of (from, until); until is null while
    deleted. A key known only from the deletions has no row: it never existed. Repeated rows count once.
    """
    born = parents.select(reference_key(F.col(key)).alias("key"), F.lit(True).alias("is_parent"), F.col(at).alias("parent_at"), F.lit(None).cast("struct<gone_from:timestamp_ntz,gone_until:timestamp_ntz>").alias("gone"))
    died = deletions.select(
        reference_key(F.col(key)).alias("key"), F.lit(False).alias("is_parent"), F.lit(None).cast(parents.schema[at].dataType).alias("parent_at"),
        F.struct(F.col("deleted_at").cast("timestamp_ntz").alias("gone_from"), F.col("restored_at").cast("timestamp_ntz").alias("gone_until")).alias("gone"),
    ).where(F.col("gone.gone_from").isNotNull())
    return (
        born.unionByName(died).where(F.length("key") > 0).groupBy("key")
        .agg(F.max("is_parent").alias("is_parent"), F.max("parent_at").alias("parent_at"), F.collect_set("gone").alias("gone"))
        .where("is_parent").drop("is_parent")
    )


def orphan_references(refs: DataFrame, parents: DataFrame, hot_rows: int = HOT) -> DataFrame:
    """References whose parent was not there when they were written.

    Both sides are hash-partitioned and sorted by key, then merged in one linear pass (sort-merge join). References of a key
    with more than ``hot_rows`` of them are dealt over several tasks by the edge, and its one parent row goes to each. The
    parent's validity intervals separate the kinds:
    'missing' no such parent; 'deleted' the reference falls into [deleted_at, restored_at); 'late' the parent was
    created after the reference. Null times never satisfy a comparison, so they give neither 'deleted' nor 'late'.
    Null and blank references are no references. Empty input gives an empty result. No row twice.
    Result: ref_table, ref_column, edge_id, ref_at, kind.
    """
    merged = spread_join(refs, parents.withColumn("found", F.lit(True)), "key", F.col("edge_id"), "left", hot_keys(refs, "key", hot_rows), "merge")
    at = F.col("ref_at").cast("timestamp_ntz")
    gone = F.exists("gone", lambda g: (g.gone_from <= at) & (g.gone_until.isNull() | (g.gone_until > at)))
    kind = F.when(F.col("found").isNull(), "missing").when(gone, "deleted").when(F.col("parent_at") > F.col("ref_at"), "late")
    return merged.select("ref_table", "ref_column", "edge_id", "ref_at", kind.alias("kind")).where("kind is not null").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, column, kind and month of the reference (null month: time unknown)."""
    month = F.date_format("ref_at", "yyyy-MM")
    return orphans.groupBy("ref_table", "ref_column", "kind", month.alias("month")).agg(F.count("*").alias("orphans"))
