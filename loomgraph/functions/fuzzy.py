"""Fuzzy containment of a short string in a longer one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of intent that are taken out of a query.
INTENT_PHRASES = ["question", "ask", "quiz", "test", "give", "topics", "covering", "me", "on ", "about "]


def _indel(a: str, b: str, masks: dict[str, int]) -> float:
    """Normalized Indel similarity (0 to 100) by bit-parallel longest common subsequence; masks belong to a."""
    if not a and not b:
        return 100.0
    s, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u) | (s - u)
    common = (~s & full).bit_count()
    return 200.0 * common / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best Indel similarity of the shorter string with any window of the longer one, shorter windows at its ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    masks: dict[str, int] = {}
    for k, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << k
    n, best = len(short), 0.0
    spans = [(0, e) for e in range(1, n)] + [(i, i + n) for i in range(len(long) - n + 1)] + [(i, len(long)) for i in range(len(long) - n + 1, len(long))]
    for i, j in spans:
        # a window whose border character isn't in the short string is never the only best
        if long[j - 1] in masks or long[i] in masks:
            best = max(best, _indel(short, long[i:j], masks))
    if len(short) == len(long):
        best = max(best, partial_of(long, short))
    return best


def partial_of(short: str, long: str) -> float:
    masks: dict[str, int] = {}
    for k, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << k
    n = len(short)
    spans = [(0, e) for e in range(1, n + 1)] + [(i, len(long)) for i in range(1, len(long))]
    return max((_indel(short, long[i:j], masks) for i, j in spans), default=0.0)


def normalize_query_text(query: str, above: float = 50) -> str:
    q = " ".join(query.lower().strip().replace("-", " ").replace("_", " ").split(" "))
    for phrase in INTENT_PHRASES:
        if partial_ratio(phrase, q) > above:
            q = q.replace(phrase, "")
    return " ".join(q.split())


def normalize_query(c: Column) -> Column:
    """Lower case, hyphens and underscores to blanks, intent phrases removed, single blanks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normalize_query_text(t))

    return run(c)


def best_partial_ratio(needles: Column, text: Column) -> Column:
    """The best partial ratio of any of the needles; null without needles or text."""

    @F.pandas_udf("double")
    def run(n: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for ws, x in zip(n, t):
            ws = [] if ws is None else [w for w in ws if w is not None]
            out.append(max(partial_ratio(w, x) for w in ws) if len(ws) and x is not None else None)
        return pd.Series(out, dtype="float64")

    return run(needles, text)
