"""Texts for prompts: paths, equations and the whole context of a topic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def render_path(quality: Column, score: Column, path: Column) -> Column:
    """[s|0.1234] a- rel -> b- rel -> c"""
    letter = F.when(quality == "strong", "s").when(quality == "weak", "w").otherwise("not_available")
    chain = F.aggregate(path, F.get(path, F.lit(0)).getField("source"), lambda t, e: F.concat(t, F.lit("- "), e.relation, F.lit(" -> "), e.target))
    return F.format_string("[%s|%.4f] %s", letter, F.coalesce(score, F.lit(0.0)), chain)


def render_paths(paths: Column) -> Column:
    """A line per path, from structs (path_quality, path_score, path)."""
    return F.array_join(F.transform(paths, lambda p: render_path(p.path_quality, p.path_score, p.path)), "\n")


def render_equations(items: Column) -> Column:
    """Lines of equation and intuition from structs (source, target), or None."""
    lines = F.transform(items, lambda e: F.concat(F.lit("[EQ] "), e.target, F.lit(" \n INTUITION: "), e.source))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise("None")


def render_list(values: Column) -> Column:
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def render_context(difficulty: Column, concepts: Column, chunks: Column, two_hop: Column, three_hop: Column, retrieved: Column, related: Column) -> Column:
    """The context of one difficulty: easy has the common sections, medium 2-hop paths, hard 3-hop paths and their equations."""
    common = ["## Available Entities", concepts, "", "## Supporting Knowledge", chunks, ""]
    part = lambda paths, a, eqs, b: F.concat_ws("\n", *(x if isinstance(x, Column) else F.lit(x) for x in [*common, a, paths, "", b, eqs, ""]))
    easy = F.concat_ws("\n", *(x if isinstance(x, Column) else F.lit(x) for x in common))
    medium = part(two_hop, "## Concept Paths (2-Hop)", retrieved, "## Retrieved Equations")
    hard = part(three_hop, "## Concept Paths (3-Hop)", related, "## Related Equations")
    return F.when(difficulty == "medium", medium).when(difficulty == "hard", hard).otherwise(easy)
