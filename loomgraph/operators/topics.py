"""Topic detection for free queries, and topic switches in message sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import best_partial_ratio, normalize_query


def spaced(c):
    return F.regexp_replace(F.lower(F.trim(c)), r"[-_]+", " ")


def detect_topics(queries: DataFrame, topics: DataFrame, fuzzy_above: float = 60, fuzzy: bool = True, most: int = 10_000) -> DataFrame:
    """(query, topic_id, stage): the topics of every query by the first stage that finds any.

    Stages: 1 the id, 2 the name, both with hyphens and underscores as blanks; 3 a tag contained in the query; 4 a tag
    similar to part of it (if ``fuzzy``); 5 none: all topics, for the caller to report as not found. A name ends the
    search: with it come the topics before it, by id, of which a tag is contained. With ``fuzzy`` the query, and the names,
    are read without the phrases by which people ask. Topics are a dimension and go to the queries as one array (checked: at
    most ``most``); stages before the fuzzy one stay in the JVM. Null queries have no row; topics without tags never match by tag.
    """
    if topics.select("id").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} topics")
    plain = normalize_query if fuzzy else spaced
    listed = topics.withColumn("asked", plain(F.col("name"))).select(F.struct("id", "name", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "asked").alias("t")).distinct().agg(F.array_sort(F.collect_list("t")).alias("all"))
    q = queries.select("query").where("query is not null").distinct().withColumn("q", plain(F.col("query"))).withColumn("one", F.lit(1)).join(F.broadcast(listed.withColumn("one", F.lit(1))), "one")
    stage = lambda cond: F.transform(F.filter("all", cond), lambda t: t.id)
    tagged = lambda t: F.exists(t.tags, lambda g: F.contains(F.col("q"), g))
    q = q.withColumn("named", F.array_position(F.transform("all", lambda t: F.coalesce(t.asked == F.col("q"), F.lit(False))), True))
    by_name = F.when(F.col("named") > 0, stage(lambda t, i: (i == F.col("named") - 1) | ((i < F.col("named") - 1) & tagged(t)))).otherwise(F.array().cast("array<string>"))
    staged = q.select("query", "q", "all", stage(lambda t: spaced(t.id) == F.col("q")).alias("s1"), by_name.alias("s2"), stage(tagged).alias("s3"))
    if fuzzy:
        rest = staged.where("size(s1) + size(s2) + size(s3) = 0").select("query", "q", F.explode("all").alias("t"))
        scored = rest.where(best_partial_ratio(F.col("t.tags"), F.col("q")) > fuzzy_above).groupBy("query").agg(F.array_sort(F.collect_list("t.id")).alias("s4"))
        staged = staged.join(scored, "query", "left").withColumn("s4", F.coalesce("s4", F.array().cast("array<string>")))
    else:
        staged = staged.withColumn("s4", F.array().cast("array<string>"))
    number = F.when(F.size("s1") > 0, 1).when(F.size("s2") > 0, 2).when(F.size("s3") > 0, 3).when(F.size("s4") > 0, 4).otherwise(5)
    found = F.when(number == 1, F.col("s1")).when(number == 2, F.col("s2")).when(number == 3, F.col("s3")).when(number == 4, F.col("s4")).otherwise(F.transform("all", lambda t: t.id))
    return staged.select("query", F.explode(found).alias("topic_id"), number.alias("stage"))


def topic_switches(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each message with its topic, carried forward when it names none, and whether that differs from the one before.

    messages: key, order columns, topic (null: none named). The first topic of a sequence is no switch.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = messages.withColumn("topic", F.last("topic", ignorenulls=True).over(before))
    last = F.lag("topic").over(Window.partitionBy(key).orderBy(*order))
    return carried.withColumn("switched", F.coalesce(F.col("topic") != last, F.lit(False)))
