"""Mapping freely entered values to a canonical list by symmetric deletes."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import hot_keys, spread_join

UNMATCHED = "UNMATCHED"
#: Words that a writer puts around a name without changing what it names.
LEADING = frozenset(
    "a an any the this that these those some each every such our its their it they which who what also often usually generally typically always sometimes "
    "clearly directly strongly strictly simply mostly mainly largely partly really actually basically just only then thus hence therefore in turn part fact general practice "
    "may might can could will would be is are was were well known so called standard classic common new".split()
)
TRAILING = frozenset("here there the a an this that too as well again method methods technique techniques approach approaches concept idea procedure scheme etc now then".split())
#: Endings by which one verb form becomes another.
VOWELS = "aeiou"


#: Deletes are taken from this many leading characters; within the edit bound two forms share a delete of their prefixes.
PREFIX = 12


def edits(a: str, b: str, most: int) -> float:
    """Weighted Damerau-Levenshtein (adjacent transpositions), or inf beyond ``most`` plain edits.

    A transposition, a doubled letter and s for z weigh a little less than another edit.
    """
    if abs(len(a) - len(b)) > most:
        return float("inf")
    inf = float("inf")
    before: list[float] = []
    row: list[float] = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [inf] * (len(b) + 1)
        if i <= most:
            new[0] = float(i)
        for j in range(lo, hi + 1):
            x, y = a[i - 1], b[j - 1]
            if x == y:
                best = row[j - 1]
            else:
                best = row[j - 1] + (0.5 if {x, y} == {"s", "z"} else 1.0)
            best = min(best, row[j] + (0.8 if i > 1 and a[i - 2] == x else 1.0), new[j - 1] + (0.8 if j > 1 and b[j - 2] == y else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 0.8)
            new[j] = best
        before, row = row, new
    return row[len(b)] if row[len(b)] <= most else inf


def deletes(s: str, most: int) -> set[str]:
    out = level = {s}
    for _ in range(most):
        level = {x[:k] + x[k + 1 :] for x in level for k in range(len(x))}
        out = out | level
    return out


def verb_forms(phrase: str) -> set[str]:
    """The phrase with its first word in the base, past and -ing forms, and with -ise for -ize."""
    first, _, rest = phrase.partition(" ")
    bases = set()
    if first.endswith("ed") and len(first) > 4:
        stem = first[:-2]
        bases |= {stem, stem + "e"} | ({stem[:-1]} if stem[-1] == stem[-2] else set())
    elif first.endswith("s") and not first.endswith("ss") and len(first) > 3:
        bases |= {first[:-1]} | ({first[:-2]} if first.endswith(("ches", "shes", "xes", "sses", "oes")) else set()) | ({first[:-3] + "y"} if first.endswith("ies") else set())
    words = {first} | bases
    for b in bases:
        if b.endswith("e"):
            words |= {b + "d", b[:-1] + "ing", b + "s"}
        else:
            words |= {b + "ed", b + "ing", b + "s"}
            if len(b) > 2 and b[-1] not in VOWELS + "wxy" and b[-2] in VOWELS and b[-3] not in VOWELS:
                words |= {b + b[-1] + "ed", b + b[-1] + "ing"}
    out = {f"{w} {rest}".strip() for w in words}
    return out | {re.sub(r"iz(?=e|i|a)", "is", w) for w in out}


def tidy(value: str) -> str:
    """Case, width, accents, invisible characters, joining marks, quotes, citations and outer punctuation undone."""
    s = unicodedata.normalize("NFKC", value)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    if " " not in s.strip():
        s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    s = s.lower()
    s = re.sub(r"\[[^\]]*\]|\{[^}]*\}", " ", s)
    s = re.sub(r"[_\-‐-―/\s]+", " ", s)
    return re.sub(r"^[^\w(]+|[^\w).]+$|[\"'`“”‘’*«»]", "", s).strip()


def readings(value: str) -> list[str]:
    """The ways in which a tidied value may be read: inverted at a comma or bracket, without its remarks and fillers."""
    s = tidy(value)
    out = [s]
    if m := re.fullmatch(r"(.+?)\s*\(([^)]*)\)\s*", s):
        out += [f"{m[2]} {m[1]}", m[1]]
    if m := re.fullmatch(r"([^,]+),\s*([^,]+)", s):
        out += [f"{m[2]} {m[1]}"]
    plain = []
    for x in out:
        words = [w for w in re.sub(r"[^\w. ]+", " ", x).split() if w.strip("._")]
        words = [w if re.fullmatch(r"\w+\.", w) and k < len(words) else w.strip(".") for k, w in enumerate(words)]
        plain.append(words)
    result = []
    for words in plain:
        for lo in range(len(words)):
            if lo and words[lo - 1] not in LEADING:
                break
            for hi in range(len(words), lo, -1):
                if hi < len(words) and words[hi].strip(".") not in TRAILING:
                    break
                result.append(" ".join(words[lo:hi]))
    return list(dict.fromkeys(result))


def _initials(words: list[str]) -> str:
    """What a name and its abbreviation share: the first two letters of every word."""
    return " ".join(w[:2] for w in words)


@dataclass
class Dictionary:
    """Canonical entries with their other forms, indexed by symmetric deletes of the forms without blanks."""

    entries: list[tuple[str, list[str]]]
    frequency: dict[str, int] = field(default_factory=dict)
    verbs: bool = False
    most: int = 2
    largest: int = 20_000

    def __post_init__(self) -> None:
        if sum(1 + len(forms) for _, forms in self.entries) > self.largest:
            raise ValueError(f"the reference list has more than {self.largest} forms; it is broadcast only up to that bound")
        self.forms: dict[str, tuple[str, str]] = {}  # without blanks -> (with blanks, canonical)
        self.words: set[str] = set()
        self.initials: dict[str, list[tuple[list[str], str]]] = defaultdict(list)
        self.index: dict[str, list[str]] = defaultdict(list)
        for name, others in sorted(self.entries, key=lambda e: (-self.frequency.get(e[0], 0), e[0])):
            for k, form in enumerate([name, *others]):
                text = " ".join(re.sub(r"[^\w ]+", " ", tidy(form)).split())
                if not text:
                    continue
                variants = {text}
                if self.verbs:
                    variants |= verb_forms(text)
                else:
                    plural = text[:-1] + "ies" if re.search("[^aeiou]y$", text) else text + "s"
                    variants |= {plural, text + "s"} if text[-1].isalpha() and not text.endswith("s") else set()
                for v in sorted(variants, key=lambda v: (v != text, v)):
                    compact = v.replace(" ", "")
                    if compact not in self.forms:
                        self.forms[compact] = (v, name)
                    self.words |= set(v.split())
                words = text.split()
                self.initials[_initials(words)].append((words, name))
        for compact in self.forms:
            for d in deletes(compact[:PREFIX], self.allowed(compact)):
                self.index[d].append(compact)

    def allowed(self, compact: str) -> int:
        """Edits tolerated: none in codes and very short forms, more in longer ones."""
        if any(c.isdigit() for c in compact) or len(compact) < 5:
            return 0
        return 1 if len(compact) < 12 else self.most

    def find(self, value: str) -> str:
        ways = readings(value)
        for x in ways:
            if hit := self.forms.get(x.replace(" ", "").replace(".", "")):
                return hit[1]
        for x in ways:
            if "." in x and (hit := self.abbreviated(x.split())):
                return hit
        best: tuple[float, int, str] | None = None
        for x in ways:
            x = x.replace(".", "")
            compact = x.replace(" ", "")
            if not compact:
                continue
            typed = x.split()
            index = self.index
            near = {c for d in deletes(compact[:PREFIX], self.allowed(compact)) if d in index for c in index[d]}
            for c in near:
                form, name = self.forms[c]
                if abs(len(c) - len(compact)) > self.most or not self.same_words(typed, form.split()):
                    continue
                n = edits(compact, c, min(self.allowed(compact), self.allowed(c)))
                rank = (n, -self.frequency.get(name, 0), name)
                if n <= self.most and (best is None or rank < best):
                    best = rank
            if best:
                break
        return best[2] if best else UNMATCHED

    def keys(self) -> Iterator[str]:
        """What an entry is found by: deletes of its forms' beginnings, and its initials."""
        yield from (f"d{k}" for k in self.index)
        yield from (f"i{k}" for k in self.initials)

    def keys_of(self, value: str) -> tuple[set[str], set[str]]:
        """What ``find`` would look a value up by, and the words in it."""
        keys, words = set(), set()
        for x in readings(value):
            if "." in x:
                keys.add(f"i{_initials(x.split())}")
            x = x.replace(".", "")
            words |= set(x.split())
            compact = x.replace(" ", "")
            keys |= {f"d{d}" for d in deletes(compact[:PREFIX], self.allowed(compact))}
        return keys, words

    def same_words(self, typed: list[str], form: list[str]) -> bool:
        """A word that is spelled right, but isn't in the form, makes the value another name."""
        if len(typed) != len(form):
            return True
        return all(a == b or a not in self.words or a + "s" == b or b + "s" == a for a, b in zip(typed, form))

    def abbreviated(self, typed: list[str]) -> str | None:
        """The entry whose words begin with the typed ones, each either whole or ending with a full stop."""
        found = [
            (-self.frequency.get(name, 0), name)
            for words, name in self.initials.get(_initials(typed), [])
            if all(w.startswith(t[:-1]) and len(t) > 2 if t.endswith(".") else w == t or w + "s" == t for t, w in zip(typed, words))
        ]
        return min(found)[1] if found else None


def canonical_values(values: DataFrame, keys: list[str], value: str, dictionary: Dictionary, remember: int = 200_000) -> DataFrame:
    """The canonical entry each value stands for, or UNMATCHED.

    The dictionary (at most ``largest`` forms, checked) goes to the workers with the function; values stay where they
    are, each worker remembers the last values it has seen, so frequent values are looked up once per worker and
    nothing is shuffled. Among entries within the bounded edit distance the smallest weighted Damerau-Levenshtein
    distance wins, then the entry of highest frequency, then the smaller name.

    Defined cases: null and blank values, and values that are letter for letter canonical, have no row (filtered before
    Python); values of any length are compared; repeated rows count once; an empty reference list leaves everything
    unmatched. Result: keys, canonical. See ``mapped`` for lists of any length.
    """
    names = [name for name, _ in dictionary.entries]
    rows = values.select(*keys, F.col(value).alias("value")).where(F.col("value").isNotNull() & (F.trim("value") != ""))
    if names:
        rows = rows.where(~F.col("value").isin(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for b in batches:
            out = []
            for v in b["value"]:
                if (hit := known.get(v)) is None:
                    if len(known) >= remember:
                        known.clear()
                    hit = known[v] = dictionary.find(v)
                out.append(hit)
            yield b.drop(columns="value").assign(canonical=out)

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", canonical string"
    return rows.mapInPandas(run, schema).distinct()


def mapped(values: DataFrame, keys: list[str], value: str, entries: DataFrame, name: str, forms: str, verbs: bool = False, largest: int = Dictionary.largest) -> DataFrame:
    """canonical_values against a table of entries (a name and a list of its other forms), of any length.

    A list of at most ``largest`` forms (counted) is broadcast as a dictionary. A longer one is joined: entries and the
    distinct values are keyed by their deletes and initials, what meets are a value's candidates, and the same dictionary
    is made of these alone, so the result is the same. How often an entry is named letter for letter is its frequency.
    """
    listed = entries.select(F.col(name).alias("name"), F.coalesce(F.array_compact(F.col(forms)), F.array().cast("array<string>")).alias("forms")).where("name is not null").distinct()
    rows = values.select(*keys, F.col(value).alias("value")).where(F.col("value").isNotNull() & (F.trim("value") != ""))
    size = listed.agg(F.sum(1 + F.size("forms"))).first()[0] or 0
    if size <= largest:
        own = listed.collect()
        names = [r[0] for r in own]
        counts = rows.where(F.col("value").isin(names)).groupBy("value").count().collect() if names else []
        return canonical_values(values, keys, value, Dictionary([(r[0], list(r[1])) for r in own], {r[0]: r[1] for r in counts}, verbs, largest=largest))

    names = listed.select("name").distinct()
    counted = rows.join(names.withColumnRenamed("name", "value"), "value").groupBy(F.col("value").alias("name")).agg(F.count("*").alias("n"))
    listed = listed.join(counted, "name", "left").select("name", "forms", F.coalesce("n", F.lit(0)).alias("n"))
    free = rows.join(names.withColumnRenamed("name", "value"), "value", "left_anti")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for e, f, n in zip(b["name"], b["forms"], b["n"]):
                d = Dictionary([(e, list(f))], verbs=verbs)
                out += [(k, e, f, n) for k in {*d.keys(), *(f"w{w}" for w in d.words)}]
            yield pd.DataFrame(out, columns=["key", "name", "forms", "n"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Dictionary([], verbs=verbs)
        for b in batches:
            out = []
            for v in b["value"]:
                wanted, words = d.keys_of(v)
                out += [(k, v) for k in wanted] + [(f"w{w}", v) for w in words]
            yield pd.DataFrame(out, columns=["key", "value"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v, near, words in zip(b["value"], b["near"], b["words"]):
                d = Dictionary([(e["name"], list(e["forms"])) for e in near], {e["name"]: e["n"] for e in near}, verbs, largest=1 << 62)
                d.words |= set(words)
                out.append(d.find(v))
            yield pd.DataFrame({"value": b["value"], "canonical": out})

    table = listed.mapInPandas(index, "key string, name string, forms array<string>, n long")
    known = table.where("key like 'w%'").select("key").distinct()
    asked = free.select("value").distinct().mapInPandas(ask, "key string, value string")
    words = asked.where("key like 'w%'").join(known, "key").groupBy("value").agg(F.collect_set(F.substr("key", F.lit(2))).alias("words"))
    near = asked.where("key not like 'w%'").join(table.where("key not like 'w%'"), "key").groupBy("value").agg(F.collect_set(F.struct("name", "forms", "n")).alias("near"))
    both = near.join(words, "value", "left").select("value", "near", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    found = both.mapInPandas(answer, "value string, canonical string")
    out = spread_join(free, found, "value", F.hash(*[F.col(k) for k in keys]), "left", hot_keys(free, "value"))
    return out.select(*keys, F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical")).distinct()
