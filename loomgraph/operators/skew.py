"""Joins of many rows with one row a key, where a few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task takes at least, and keys that may be dealt over several tasks at most.
HOT, MOST = 100_000, 1_000


def hot_keys(rows: DataFrame, key: str, least: int = HOT, most: int = MOST) -> DataFrame | None:
    """(key, _salts) of the keys with more than ``least`` rows and more than one in ``most`` of all rows, so fewer than
    ``most`` of them; None if there are none. Rows are counted with partial aggregates, hot keys only come to the driver."""
    total = rows.count()
    limit = max(least, total // most)
    if total <= limit:
        return None
    found = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull() & (F.col("n") > limit)).collect()
    return rows.sparkSession.createDataFrame([(r[0], -(-r[1] // limit)) for r in found], rows.select(key).schema.add("_salts", "integer")) if found else None


def spread_join(rows: DataFrame, single: DataFrame, key: str, by: Column, how: str = "inner", hot: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """``rows`` joined with ``single``, which has one row a key; a hot key's rows are dealt by the hash of ``by`` over as many
    tasks as it has salts, and its one row goes to each of these."""
    on: str | list[str] = key
    if hot is not None:
        few = F.broadcast(hot)
        salts = F.coalesce("_salts", F.lit(1))
        rows = rows.join(few, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
        single = single.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        on = [key, "_salt"]
    if hint:
        rows, single = rows.hint(hint), single.hint(hint)
    return rows.join(single, on, how).drop("_salt")
