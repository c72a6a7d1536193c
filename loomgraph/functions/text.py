"""Text functions on columns. Everything a regular expression can say stays in the JVM; balanced braces and HTML go through Arrow."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Where an encyclopedia page's text begins, and the headings behind which it ends.
PAGE_START = "From Wikipedia, the free encyclopedia"
PAGE_ENDS = ["References", "External links", "Sources", "See also"]
STOP_ENTITIES = ["exam", "hours", "details", "example", "curve", "study"]
DROPPED_CLASSES = ["toc", "navbox", "reference", "reflist", "mw-editsection", "sidebar", "metadata"]
CONTENT_ROOTS = [("class", "mw-parser-output"), ("class", "mw-body-content"), ("id", "mw-content-text"), ("tag", "body")]
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


def lowered_tokens(c: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def normalize_whitespace(c: Column) -> Column:
    """All white space (Unicode) to single blanks; the text behind the page start; cut at each end heading in turn; trimmed."""
    t = F.regexp_replace(c, r"(?U)\s+", " ")
    at = F.instr(t, PAGE_START)
    t = F.when(at > 0, F.substr(t, at + F.lit(len(PAGE_START)))).otherwise(t)
    for marker in PAGE_ENDS:
        t = F.substring_index(t, marker, 1)
    return F.trim(t)


def equations(c: Column) -> Column:
    """What stands between pairs of $$, trimmed; empty ones are dropped before trimming."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)\$\$(.*?)\$\$"), F.lit(1))
    return F.transform(F.filter(found, lambda e: F.length(e) > 0), lambda e: F.regexp_replace(e, r"^\s+|\s+$", ""))


def variables(eqs: Column, longest: int = 20) -> Column:
    """Sorted distinct names (an optional backslash, letters, one optional subscript) of at most ``longest`` characters."""
    names = F.flatten(F.transform(eqs, lambda e: F.regexp_extract_all(e, F.lit(r"\\?[a-zA-Z]+(?:_[a-zA-Z0-9]+)?"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.length(n) <= longest)))


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\d+\]", "")


def normalize_entity(c: Column) -> Column:
    """Lower case, trimmed, without [n] and quotes, with single blanks."""
    t = F.regexp_replace(strip_citations(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")), "[\"'`]", "")
    return F.regexp_replace(t, r"(?U)\s+", " ")


def split_sentences(c: Column, longer_than: int = 10) -> Column:
    """Sentences end at white space behind . ? or !, and at line breaks, as list items and headings have no full stop."""
    parts = F.transform(F.split(c, r"\s*\n\s*|(?<=[.?!])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def holds_word(text: Column, word: Column) -> Column:
    """Whether the word, taken literally, stands in the text between word boundaries."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.regexp_replace(word, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E\b"))
    return F.regexp_like(text, quoted)


def canonical_prompt(c: Column) -> Column:
    """Line ends to LF, no white space at line ends, at most one empty line in a row, trimmed."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t\f\x0B]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# The characters that count as fragments of a formula when at least five of them stand before it.
FRAGMENT = re.compile(r"[A-Za-z0-9βμσΦπθλωαδγΩεητκ\[\]()=+\-/*^,.;:{}_\\\s]{5,}$")
FORMULA = r"{\displaystyle"


def replace_displaystyle_text(text: str, eat_before: bool = True) -> str:
    """Formulas of the form {\\displaystyle ...}, nested braces included, as $$ ... $$; an unbalanced one runs to the end.

    eat_before: the formula-like run directly before a formula (its plain-text fragments) is dropped.
    """
    out, at = [], 0
    for m in re.finditer(re.escape(FORMULA), text):
        if m.start() < at:
            continue
        before = text[at : m.start()]
        out.append(FRAGMENT.sub("", before) if eat_before else before)
        depth, end = 0, len(text)
        for brace in re.finditer(r"[{}]", text[m.start() :]):
            depth += 1 if brace[0] == "{" else -1
            if depth == 0:
                end = m.start() + brace.start()
                break
        out.append(f" $$ {' '.join(text[m.end() : end].split())} $$ ")
        at = end + 1
    return " ".join("".join([*out, text[at:]]).split())


def replace_displaystyle(c: Column, eat_before: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else replace_displaystyle_text(t, eat_before))

    return run(c)


class _Page(HTMLParser):
    """Collects the text below each candidate root, leaving out dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[int]]] = []
        self.roots: dict[int, list[str]] = {}
        self.tex: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        kinds = [k for k, (what, name) in enumerate(CONTENT_ROOTS) if (what == "class" and name in classes) or (what == "id" and a.get("id") == name) or (what == "tag" and tag == name)]
        if tag in VOID_TAGS:
            return
        dropped = tag in ("script", "style", "sup", "math") or any(c in DROPPED_CLASSES for c in classes)
        if tag == "annotation" and a.get("encoding") == "application/x-tex" and any(t == "math" for t, *_ in self.open):
            self.tex = []
        new = [k for k in kinds if k not in self.roots]
        for k in new:
            self.roots[k] = []
        self.open.append((tag, dropped, new))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, *_ in self.open):
            return
        while self.open:
            t, _, _ = self.open.pop()
            if t == "annotation" and self.tex is not None:
                latex, self.tex = "".join(self.tex).strip(), None
                if not any(d for n, d, _ in self.open if n != "math"):
                    self.put(f"$$ {latex} $$")
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.tex is not None:
            self.tex.append(data)
        elif not any(d for _, d, _ in self.open):
            self.put(data)

    def put(self, data: str) -> None:
        if data.strip():
            for k in {k for *_, ks in self.open for k in ks}:
                self.roots[k].append(data.strip())


def html_text(html: str) -> str | None:
    """The text of the first content root there is, or None when there is none."""
    page = _Page()
    page.feed(html)
    page.close()
    for k in range(len(CONTENT_ROOTS)):
        if k in page.roots:
            return " ".join(page.roots[k])
    return None


def html_clean(c: Column) -> Column:
    """Readable text of a page, formulas as $$ ... $$; null when the page has no content root."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else html_text(t))

    return normalize_whitespace(replace_displaystyle(run(c)))


def html_strip(c: Column) -> Column:
    """The regular part only: scripts and styles, then tags, to blanks; for markup without dropped classes."""
    t = F.regexp_replace(c, r"(?is)<(script|style|sup)\b[^>]*>.*?</(script|style|sup)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " "))
