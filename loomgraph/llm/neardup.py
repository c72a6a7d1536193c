"""Near-duplicate texts: groups of records whose word shingles overlap beyond a threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import setjoin as J

U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def shingle_sets(texts: list, width: int, least_words: int, slice_chars: int = 1 << 20) -> J.Sets:
    """Hashed sequences of ``width`` words (runs of a-z and 0-9 in the lower-cased text) of texts with ``least_words``.

    Texts are hashed together in slices of about ``slice_chars`` characters, which bounds the working arrays; a text is never cut.
    """
    rows = [k for k, t in enumerate(texts) if isinstance(t, str) and t]
    parts, at = [], 0
    while at < len(rows):
        end, chars = at, 0
        while end < len(rows) and (end == at or chars + len(texts[rows[end]]) <= slice_chars):
            chars += len(texts[rows[end]])
            end += 1
        parts.append(_sliced(texts, np.array(rows[at:end], np.int64), width, least_words))
        at = end
    if not parts:
        return _NO_SETS
    size = np.concatenate([s.size for s in parts])
    return J.Sets(np.concatenate([s.row for s in parts]), np.concatenate([[0], np.cumsum(size)]), np.concatenate([s.tokens for s in parts]))


_NO_SETS = J.Sets(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, U))


def _sliced(texts: list, rows: np.ndarray, width: int, least_words: int) -> J.Sets:
    raw = [texts[k].lower().encode("ascii", "replace") for k in rows]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    inside = _WORD[buf]
    step = np.diff(inside.astype(np.int8), prepend=0)
    begin, at = np.flatnonzero(step == 1), np.flatnonzero(inside)
    if len(begin) < width:
        return _NO_SETS
    length = np.flatnonzero(step == -1) - begin
    first = np.cumsum(length) - length
    local = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, U))
    word = J.mix(np.add.reduceat((buf[at].astype(U) + U(1)) * power[local], first) + length.astype(U))
    doc = np.searchsorted(bounds, begin, side="right") - 1
    h = word[: len(word) - width + 1]
    for k in range(1, width):
        h = J.mix(h) + word[k : len(word) - width + 1 + k]
    h = J.mix(h)
    enough = np.bincount(doc, minlength=len(rows)) >= least_words
    same = (doc[: len(h)] == doc[width - 1 :]) & enough[doc[: len(h)]]
    sets = J.ragged(np.arange(len(rows)), doc[: len(h)][same], h[same])
    return J.Sets(rows[sets.row], sets.start, sets.tokens)


def similar_texts(items: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of every text, and the pairs of different classes with a Jaccard of at least ``threshold``.

    Members: key, hi, lo, size (the class signature and its number of shingles). Links: a_hi, a_lo, b_hi, b_lo,
    similarity. Copies share a class, so a group of copies costs one set; see setjoin for the method: block-skipping index
    lists by position, then answers derived from highly similar sets' answers.

    Defined cases: null, empty and short texts (fewer than ``least_words`` words) take part in nothing; texts of any
    length take part whole; a key with several different texts belongs to several classes; repeated rows count once;
    an empty input gives two empty frames. Only the two named columns are read.
    """
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def extract(b: pd.DataFrame) -> J.Sets:
        return shingle_sets(list(b["t"]), width, least_words)

    # a word and the mark after it have some six characters
    members, links = J.similar_classes(rows, "k", extract, F.length("t") / 6, threshold)
    return members.withColumnRenamed("k", key), links


def expanded(members: DataFrame, key: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair of different keys of equal or linked classes, the smaller key first, each once.

    The number of rows is that of the result asked for; use groups() where pairs of copies aren't needed.
    """
    m = members.select(key, "hi", "lo").distinct()
    left, right = m.select(F.col(key).alias("x"), "hi", "lo"), m.select(F.col(key).alias("y"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    copies = left.join(right, (F.col("hi") == F.col("hi2")) & (F.col("lo") == F.col("lo2")) & (F.col("x") < F.col("y"))).select("x", "y")
    near = (
        links.select("a_hi", "a_lo", "b_hi", "b_lo")
        .join(left, (F.col("a_hi") == F.col("hi")) & (F.col("a_lo") == F.col("lo")))
        .join(right, (F.col("b_hi") == F.col("hi2")) & (F.col("b_lo") == F.col("lo2")))
        .where("x <> y")
    )
    return copies.unionByName(near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct().select(F.col("x").alias(a), F.col("y").alias(b))


def groups(members: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """One row per key: group_id, the smallest key of its group (keys connected through copies and links), and its class."""
    from loomgraph.operators.components import connected_components

    name = lambda p: F.concat_ws(":", F.hex(f"{p}hi"), F.hex(f"{p}lo"))
    m = members.select(key, name("").alias("class_id"), "size")
    edges = links.select(name("a_").alias("a"), name("b_").alias("b"))
    comp = connected_components(edges, "a", "b")
    joined = m.join(comp, m.class_id == comp.node, "left").select(key, "class_id", F.coalesce("component", "class_id").alias("component"))
    first = joined.groupBy("component").agg(F.min(key).alias("group_id"))
    return joined.join(first, "component").select(key, "class_id", "group_id").distinct()
