"""All similar pairs between set-valued records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import setjoin as J

U = np.uint64


def normal_set(values: Column) -> Column:
    """Values trimmed (U+0020) and lower-cased, nulls and repeats dropped; a null list is the empty set."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull()))


def similar_sets(records: DataFrame, key: str, values: Column, threshold: float = 0.6, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of every set, and all pairs of different classes with a Jaccard of at least ``threshold``.

    The named pivot partitioning sends nearly every set to nearly every cell here (figures in the README), so this is a
    prefix join instead: a set is assigned to the cells of its rarest values, as many as the overlap at the threshold asks
    for, two similar sets meet in one at least, and what meets is verified on the whole sets. Equal sets form one class and
    are joined once.

    Defined cases: null elements are dropped, null and empty lists and sets of fewer than ``least`` values take part in
    nothing; repeated rows count once; a key with several sets belongs to several classes; sets of any size take part
    whole; an empty input gives two empty frames. Only the key and the values are read.
    """
    hashes = F.array_sort(F.array_distinct(F.transform(normal_set(values), lambda v: F.xxhash64(v))))
    rows = records.select(F.col(key).alias("k"), hashes.alias("h")).where(F.size("h") >= least)

    def extract(b: pd.DataFrame) -> J.Sets:
        lists = list(b["h"])
        size = np.array([len(x) for x in lists], np.int64)
        if not len(size):
            return J.Sets(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, U))
        owner = np.repeat(np.arange(len(size)), size)
        return J.ragged(np.arange(len(size)), owner, J.mix(np.concatenate(lists).astype(np.int64).view(U)), least)

    members, links = J.similar_classes(rows, "k", extract, F.size("h"), threshold)
    return members.withColumnRenamed("k", key), links


def link_counts(members: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """One row per record: its class, the number of records in the class, and of other records its class is linked with."""
    sizes = members.groupBy("hi", "lo").agg(F.countDistinct(key).alias("copies"))
    ends = links.select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), F.col("b_hi").alias("hi2"), F.col("b_lo").alias("lo2"))
    ends = ends.unionByName(ends.select(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2")))
    other = sizes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("copies").alias("n"))
    near = ends.join(other, ["hi2", "lo2"]).groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    counted = sizes.join(near, ["hi", "lo"], "left").select("hi", "lo", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    name = F.concat_ws(":", F.hex("hi"), F.hex("lo")).alias("class_id")
    return members.join(counted, ["hi", "lo"]).select(key, name, "copies", "links")
