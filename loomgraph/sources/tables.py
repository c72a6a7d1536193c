"""Sources and sinks: Parquet tables, JSON dimensions, appends with guards, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources import schemas


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def topic_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of topics with the addresses of their pages; all topics, one row each."""
    return spark.read.schema(schemas.TOPIC_SOURCE).option("multiLine", True).json(path)


def _entries(spark: SparkSession, path: str, kind: str, value: str) -> DataFrame:
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", value))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """id, name and tags from a JSON object of id to name, or id to [name, tags]."""
    raw = _entries(spark, path, "string", "v")
    pair = F.from_json("v", "array<string>")
    tags = F.from_json(F.get(pair, F.lit(1)), "array<string>")
    plain = F.col("v").startswith("[")
    return raw.select(F.col("key").alias("id"), F.when(plain, F.get(pair, F.lit(0))).otherwise(F.col("v")).alias("name"), F.when(plain, tags).otherwise(F.array().cast("array<string>")).alias("tags"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """synonym and canonical entity from a flat JSON object."""
    return _entries(spark, path, "string", "canonical").withColumnRenamed("key", "synonym")


def relation_phrases(spark: SparkSession, path: str) -> DataFrame:
    """relation and phrases from a JSON object of canonical relation to phrases."""
    return _entries(spark, path, "array<string>", "phrases").withColumnRenamed("key", "relation")


def apply_synonyms(entity: Column, rows: DataFrame, plural: DataFrame, synonym: DataFrame, into: str = "normalized_text") -> DataFrame:
    """rows with the entity mapped by the plural list, then by the synonym list; others stay. Both lists are dimensions."""
    p = plural.select(F.col("synonym").alias("_p"), F.col("canonical").alias("_pc"))
    s = synonym.select(F.col("synonym").alias("_s"), F.col("canonical").alias("_sc"))
    one = rows.withColumn("_e", entity).join(p, F.col("_e") == F.col("_p"), "left").withColumn("_e", F.coalesce("_pc", "_e"))
    return one.join(s, F.col("_e") == F.col("_s"), "left").withColumn(into, F.coalesce("_sc", "_e")).drop("_e", "_p", "_pc", "_s", "_sc")


def append(df: DataFrame, path: str, schema: T.StructType, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Appends rows to a table.

    The declared columns have to be there with types that cast to the declared ones; an empty batch raises, as does a missing
    column. ``_id`` and undeclared columns are not written. Rows are sorted within files, which with the partitioning stands for key indexes.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"the batch lacks {', '.join(missing)}")
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if out.isEmpty():
        raise ValueError("an empty batch")
    if sort_by:
        out = out.sortWithinPartitions(*sort_by)
    writer = out.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """A table bucketed and sorted by its keys, so that joins on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON file, times as text, for people to read."""
    text = [F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    df.select(*text).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _xml(c: str) -> Column:
    t = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def export_gexf(nodes: DataFrame, edges: DataFrame, path: str, node: str = "chunk_id", source: str = "source", target: str = "target", weight: str = "weight") -> None:
    """A graph as GEXF text, written by the executors in order: one file, never gathered on the driver."""
    spark = nodes.sparkSession
    line = lambda k, *parts: spark.createDataFrame([(k, "", p) for p in parts], "part int, k string, value string")
    n = nodes.select(F.lit(1).alias("part"), _xml(node).alias("k"), F.concat(F.lit('<node id="'), _xml(node), F.lit('" label="'), _xml(node), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(3).alias("part"), F.concat_ws(" ", source, target).alias("k"), F.concat(F.lit('<edge source="'), _xml(source), F.lit('" target="'), _xml(target), F.lit('" weight="'), _xml(weight), F.lit('"/>')).alias("value"))
    rows = [line(0, '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'), n, line(2, "</nodes><edges>"), e, line(4, "</edges></graph></gexf>")]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every.repartition(1).sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)
