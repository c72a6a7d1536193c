"""Splitting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest; a cut falls behind the match. The last resort is a cut between any two characters.
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n+", r"[.!?…][\"'”’)\]]*\s+", r"[;:]\s+", r",\s+", r"\s+")]


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the cores: each core, with the overlap before it, has at most ``limit`` characters."""
    room = limit - overlap
    found = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]

    def pick(lo: int, hi: int) -> int:
        """The strongest boundary within the middle half of the span, there the one nearest to the midpoint."""
        middle, quarter = (lo + hi) / 2, (hi - lo) / 4
        for ends in found:
            at = _nearest(ends, middle)
            if at is not None and lo < at < hi and abs(at - middle) <= quarter:
                return at
        return _whole(text, (lo + hi) // 2, int(lo + quarter))

    out, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        # the first piece has no overlap before it
        if hi - lo <= (limit if lo == 0 else room):
            out.append(hi)
            continue
        at = pick(lo, hi)
        todo += [(at, hi), (lo, at)]
    return out


def _nearest(ends: list[int], middle: float) -> int | None:
    from bisect import bisect_left

    k = bisect_left(ends, middle)
    near = ends[max(0, k - 1) : k + 1]
    return min(near, key=lambda e: abs(e - middle)) if near else None


def _whole(text: str, at: int, least: int) -> int:
    """Moves a forced cut back off the inside of a combining sequence, unless that fills a quarter of the span."""
    import unicodedata

    for k in range(at - least):
        if at - k > 0 and not unicodedata.combining(text[at - k]) and text[at - k] not in "‍️":
            return at - k
    return at


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; each starts ``overlap`` characters before the end of the one before it."""
    ends = cuts(text, limit, overlap)
    return [(max(0, lo - overlap) if k else 0, hi) for k, (lo, hi) in enumerate(zip([0, *ends], ends))]


def split_texts(items: DataFrame, key: str, text: str = "text", limit: int = 1200, overlap: int = 100) -> DataFrame:
    """Numbered pieces of at most ``limit`` code points; consecutive pieces overlap by ``overlap`` code points.

    Recursive bisection: the span is cut at the strongest boundary near its midpoint, halves still longer than
    limit - overlap are cut again, then the overlaps are attached. Dropping each piece's overlap gives the text back.
    Texts within the limit come out as one piece without leaving the JVM; only longer ones go through Python, and
    there is no shuffle but the one that makes repeated rows count once.

    Defined cases: a null text has no piece; an empty text has one empty piece; equal keys with different texts are
    split separately. Result: key, piece_no, n_pieces, start, piece.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be at least 0 and less than half the limit")
    rows = items.select(F.col(key), F.col(text).alias("text")).where("text is not null")
    short = rows.where(F.length("text") <= limit).select(key, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col("text").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b["text"]):
                spans = pieces(t, limit, overlap)
                out += [(k, n, len(spans), lo, t[lo:hi]) for n, (lo, hi) in enumerate(spans)]
            yield pd.DataFrame(out, columns=[key, "piece_no", "n_pieces", "start", "piece"])

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, piece_no int, n_pieces int, start int, piece string"
    long = rows.where(F.length("text") > limit).distinct().mapInPandas(run, schema)
    return short.distinct().unionByName(long)
