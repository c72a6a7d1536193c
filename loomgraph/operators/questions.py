"""Question bank: buckets, versions, template questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concept_buckets(buckets: DataFrame) -> DataFrame:
    """(concept, bucket_name): a primary concept belongs to the last bucket that lists it, a secondary one to the first.

    Primary wins over secondary. buckets: bucket_pos, bucket_name, primary_concepts, secondary_concepts.
    """
    p = buckets.select(F.explode("primary_concepts").alias("concept"), F.lit(0).alias("kind"), (-F.col("bucket_pos")).alias("o"), "bucket_name")
    s = buckets.select(F.explode("secondary_concepts").alias("concept"), F.lit(1).alias("kind"), F.col("bucket_pos").alias("o"), "bucket_name")
    return p.unionByName(s).groupBy("concept").agg(F.min(F.struct("kind", "o", "bucket_name")).alias("m")).select("concept", F.col("m.bucket_name").alias("bucket_name"))


def add_buckets(questions: DataFrame, buckets: DataFrame, concept: str = "primary_concept") -> DataFrame:
    """Every question with the bucket of its concept, or Uncategorized."""
    known = concept_buckets(buckets).withColumnRenamed("concept", concept)
    return questions.join(known, concept, "left").withColumn("bucket_name", F.coalesce("bucket_name", F.lit("Uncategorized")))


def group_concepts(edges: DataFrame, labels: DataFrame, primary: int = 6, secondary: int = 6) -> DataFrame:
    """Buckets by label: its concepts of highest degree, the next ones secondary (a stand-in for a language model)."""
    from loomgraph.operators.edges import symmetric

    degree = symmetric(edges.select("source", "target").distinct(), "source", "target").groupBy("node").agg(F.countDistinct("neighbour").alias("degree"))
    named = labels.select(F.col("name").alias("node"), "label").where("label is not null").distinct().join(degree, "node")
    by = Window.partitionBy("label").orderBy(F.col("degree").desc(), "node")
    top = named.withColumn("n", F.row_number().over(by)).where(F.col("n") <= primary + secondary)
    name = lambda lo, hi: F.array_sort(F.collect_list(F.when(F.col("n").between(lo, hi), F.col("node"))))
    made = top.groupBy("label").agg(name(1, primary).alias("primary_concepts"), name(primary + 1, primary + secondary).alias("secondary_concepts"))
    return made.select(F.dense_rank().over(Window.orderBy("label")).alias("bucket_pos"), F.col("label").alias("bucket_name"), "primary_concepts", "secondary_concepts")


def latest(rows: DataFrame, keys: list[str], order: list, strict: bool = False) -> DataFrame:
    """The latest row of every key; strict raises when there is none at all."""
    if strict and rows.isEmpty():
        raise LookupError("no version found")
    by = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def latest_bank(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows at the highest version of their key."""
    by = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return rows.withColumn("_r", F.rank().over(by)).where("_r = 1").drop("_r")


def template_questions(paths: DataFrame, topic: str | Column, difficulty: str) -> DataFrame:
    """A question per path of a topic (a name, or a column of the paths), from its first and last concept (a stand-in for a language model). The id is the content's hash."""
    ends = F.split("nodes", " > ")
    first, last = F.get(ends, F.lit(0)), F.element_at(ends, -1)
    topic = F.lit(topic) if isinstance(topic, str) else topic
    text = F.concat(F.lit("How does "), first, F.lit(" relate to "), last, F.lit("?"))
    return paths.select(topic.alias("topic"), F.lit(difficulty).alias("difficulty"), F.sha2(F.concat_ws("\x01", topic, F.lit(difficulty), "nodes"), 256).alias("question_id"), text.alias("question"), first.alias("primary_concept"))


def fetch_or_generate(bank: DataFrame, generate) -> DataFrame:
    """The stored bank, or a generated one when it is empty."""
    return generate() if bank.isEmpty() else bank


def export_rows(bank: DataFrame) -> DataFrame:
    """The columns of the exported bank, times as text."""
    return bank.select(*[F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in bank.dtypes])
