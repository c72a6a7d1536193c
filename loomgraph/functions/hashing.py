"""Canonical JSON and content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_string(c: Column) -> Column:
    """A JSON string literal; null gives null. Control characters in lower-case hex, non-ASCII as it is."""
    t = F.to_json(F.array(c))
    t = F.substr(t, F.lit(2), F.length(t) - 2)
    return F.when(c.isNull(), F.lit("null")).otherwise(t)


def json_number(c: Column) -> Column:
    """A double as JSON text that is its shortest form between 1e-3 and 1e7, as scores are."""
    return F.when(c.isNull(), F.lit("null")).otherwise(c.cast("string"))


def json_object(fields: dict[str, Column]) -> Column:
    """Keys sorted, no blanks; the values are JSON texts."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def chunk_json(row: dict[str, Column] | None = None) -> Column:
    """A chunk as its canonical JSON object, entities included."""
    entity = lambda e: json_object({"text": json_string(e.text), "normalized_text": json_string(e.normalized_text), "label": json_string(e.label), "score": json_number(e.score)})
    ents = F.when(F.col("entities").isNull(), F.lit("null")).otherwise(json_array(F.transform("entities", entity)))
    return json_object({k: json_string(F.col(k)) for k in ("chunk_id", "document_id", "source_id", "text")} | {"entities": ents})


def source_hashes(chunks: DataFrame) -> DataFrame:
    """(document_id, source_id, source_hash): SHA-256 of the chunks' canonical JSON, sorted by chunk_id.

    Independent of row order; repeated rows count once. Chunks are reduced to their JSON text before the shuffle, and a
    source's sorted texts are hashed as they stream by, so a source of any size is never held as a whole.
    """
    texts = chunks.select("document_id", "source_id", "chunk_id", chunk_json().alias("j")).distinct()
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("document_id", "source_id")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for b in batches:
            done = []
            for d, s, j in zip(b["document_id"], b["source_id"], b["j"]):
                if digest is None or (d, s) != at:
                    if digest is not None:
                        digest.update(b"]")
                        done.append((*at, digest.hexdigest()))
                    at, digest = (d, s), hashlib.sha256(b"[")
                else:
                    digest.update(b",")
                digest.update(j.encode("utf-8", "surrogatepass"))
            if done:
                yield pd.DataFrame(done, columns=["document_id", "source_id", "source_hash"])
        if digest is not None:
            digest.update(b"]")
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=["document_id", "source_id", "source_hash"])

    ordered = texts.repartition("document_id", "source_id").sortWithinPartitions("document_id", "source_id", "chunk_id", "j")
    return ordered.mapInPandas(run, f"document_id {kind['document_id']}, source_id {kind['source_id']}, source_hash string")


def knowledge_hashes(topics: DataFrame, sources: DataFrame, hashes: DataFrame) -> DataFrame:
    """(topic, sources, knowledge_hash): every topic with every source; a pair without chunks has the hash of [].

    The two lists are dimensions; their grid is built with an array on each topic row, not with a cross join.
    """
    every = sources.select("source_id").where("source_id is not null").distinct().agg(F.array_sort(F.collect_list("source_id")).alias("all"))
    listed = every.withColumn("one", F.lit(1))
    grid = topics.select(F.col("id").alias("document_id")).distinct().withColumn("one", F.lit(1)).join(F.broadcast(listed), "one").select("document_id", F.explode("all").alias("source_id"))
    filled = grid.join(hashes, ["document_id", "source_id"], "left").withColumn("h", F.coalesce("source_hash", F.sha2(F.lit("[]"), 256)))
    pairs = F.array_sort(F.collect_list(F.struct("source_id", "h")))
    body = F.transform(pairs, lambda p: F.concat(json_string(p.source_id), F.lit(":"), json_string(p.h)))
    both = filled.groupBy("document_id").agg(pairs.alias("pairs"), F.sha2(F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")), 256).alias("knowledge_hash"))
    return both.select(F.col("document_id").alias("topic"), F.map_from_entries(F.transform("pairs", lambda p: F.struct(p.source_id, p.h))).alias("sources"), "knowledge_hash")


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(json_object({"system_prompt": json_string(system), "user_prompt": json_string(user)}), 256)
