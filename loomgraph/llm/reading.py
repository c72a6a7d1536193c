"""Reading level of texts in any language, learned from a bounded sample of graded texts."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.boosting import Trees, isotonic
from loomgraph.llm.setjoin import distinct, mix

FOLDS = 5
#: Words, and the marks at which a sentence ends.
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?…;•](?=\s)|\n")
_ENDS = frozenset(".!?…;•\n")
_VOWELS = re.compile(r"[aeiouyáàâäéèêëíîïóôöúùûüœæ]+")
_MARKS = (",", ";:—–", "()[]", "?¿", "!¡", "0123456789", "$=+\\^{}<>|")
_MARK = np.zeros(0x2100, np.uint8)
for _k, _marks in enumerate(_MARKS):
    _MARK[[ord(c) for c in _marks]] = _k + 1
_AT = np.array([0.1, 0.25, 0.5, 0.75, 0.9])
SLICE_CHARS = 1 << 22
U = np.uint64


def _spread(value: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, 7): mean, deviation and five quantiles (linear between neighbours) of each text's values; ``doc`` ascends."""
    n = np.bincount(doc, minlength=docs)
    some = np.maximum(n, 1)
    mean = np.bincount(doc, weights=value, minlength=docs) / some
    square = np.bincount(doc, weights=value * value, minlength=docs) / some
    out = np.zeros((docs, 7))
    out[:, 0], out[:, 1] = mean, np.sqrt(np.maximum(0.0, square - mean * mean))
    if len(value):
        low = value.min()
        span = value.max() - low + 1
        x = np.sort(doc * span + (value - low)) - doc * span + low
        start = (np.cumsum(n) - n)[:, None]
        place = _AT * (some[:, None] - 1)
        at = place.astype(np.int64)
        last = len(x) - 1
        a, b = x[np.minimum(start + at, last)], x[np.minimum(start + np.minimum(at + 1, some[:, None] - 1), last)]
        out[:, 2:] = np.where(n[:, None] > 0, a + (b - a) * (place - at), 0.0)
    return out


class Parsed:
    """The words of a slice of texts as codes, in order, with their text and sentence; and what no term's grade changes."""

    def __init__(self, texts: list[str]):
        self.docs = len(texts)
        found = [_TOKEN.findall(t.lower()) for t in texts]
        flat = np.array(list(itertools.chain.from_iterable(found)), dtype=object)
        code, kinds = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), [])
        doc = np.repeat(np.arange(self.docs), [len(x) for x in found])
        ends = np.array([k in _ENDS for k in kinds], bool)
        word = ~ends[code] if len(code) else np.zeros(0, bool)
        part = (np.cumsum(~word) + doc)[word]
        self.code, self.doc, self.kinds = code[word].astype(np.int64), doc[word], list(kinds)
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        self.sent = np.cumsum(new) - 1
        self.sent_doc = self.doc[new]
        self.plain = self._plain(texts)

    def counts(self, doc: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc if which is None else doc[which], minlength=self.docs).astype(float)

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Distributions of length, vocabulary, syntax and cohesion."""
        docs, wide = self.docs, max(len(self.kinds), 1)
        n, m = self.counts(self.doc), self.counts(self.sent_doc)
        self.n, self.m = np.maximum(n, 1), np.maximum(m, 1)
        length = np.array([len(t) for t in texts], float)
        chars = np.array([len(k) for k in self.kinds], float)[self.code]
        share = lambda which: self.counts(self.doc, which) / self.n
        # kinds of words in a text
        own, times = np.unique(self.doc * wide + self.code, return_counts=True)
        own_doc = own // wide
        kinds = np.maximum(self.counts(own_doc), 1)
        syllables = np.array([max(1, len(_VOWELS.findall(k))) for k in self.kinds], float)[own % wide]
        syl = np.bincount(own_doc, weights=syllables, minlength=docs) / kinds
        syl2 = np.bincount(own_doc, weights=syllables**2, minlength=docs) / kinds
        # what neighbouring sentences share
        has = distinct(self.sent * wide + self.code)
        of = has // wide
        size = np.bincount(of, minlength=len(self.sent_doc))
        at = np.minimum(np.searchsorted(has, has + wide), max(len(has) - 1, 0))
        common = np.bincount(of[has[at] == has + wide], minlength=len(self.sent_doc))[:-1]
        near = self.sent_doc[:-1] == self.sent_doc[1:]
        alike = (common / np.maximum(size[:-1] + size[1:] - common, 1))[near]
        pairs = np.maximum(self.counts(self.sent_doc[:-1][near]), 1)
        co = np.bincount(self.sent_doc[:-1][near], weights=alike, minlength=docs) / pairs
        co2 = np.bincount(self.sent_doc[:-1][near], weights=alike**2, minlength=docs) / pairs
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        name = np.add.reduceat(mix((has % wide).astype(U) + U(1)), starts) if len(starts) else np.zeros(0, U)
        order = np.lexsort((name, self.sent_doc))
        first = np.ones(len(order), bool)
        first[1:] = (name[order][1:] != name[order][:-1]) | (self.sent_doc[order][1:] != self.sent_doc[order][:-1])
        different = self.counts(self.sent_doc[order][first])
        # punctuation
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _MARK[np.minimum(points, len(_MARK) - 1)]
        where = np.flatnonzero(kind)
        owner = np.searchsorted(np.cumsum(length), where, side="right")
        marks = np.bincount(owner * (len(_MARKS) + 1) + kind[where], minlength=docs * (len(_MARKS) + 1)).reshape(docs, -1)[:, 1:]
        per = np.stack([self.n, self.n, self.n, self.m, self.m, np.maximum(length, 1), self.n], 1)
        return np.column_stack([
            np.log(np.maximum(length, 1)), np.log(self.n), np.log(self.m), _spread(np.bincount(self.sent, minlength=len(self.sent_doc)).astype(float), self.sent_doc, docs), _spread(chars, self.doc, docs),
            share(chars >= 7), share(chars >= 10), share(chars >= 13), share(chars <= 3), syl, np.sqrt(np.maximum(0, syl2 - syl * syl)),
            self.counts(own_doc) / np.sqrt(self.n), self.counts(own_doc, times == 1) / self.n, marks / per, co, np.sqrt(np.maximum(0, co2 - co * co)), different / self.m,
        ])

    def graded(self, word: np.ndarray, pair: np.ndarray, middle: float) -> np.ndarray:
        """Distributions of the grades that words, neighbouring words and sentences stand for; NaN: an unknown term."""
        known = ~np.isnan(word)
        met = ~np.isnan(pair)
        filled = np.where(known, word, middle)
        each = np.bincount(self.sent, weights=filled, minlength=len(self.sent_doc)) / np.maximum(np.bincount(self.sent, minlength=len(self.sent_doc)), 1)
        k, doc = self.counts(self.doc, known), self.doc
        of = lambda which: self.counts(doc, known & which) / np.maximum(k, 1)
        return np.column_stack([
            1 - k / self.n, _spread(word[known], doc[known], self.docs), _spread(pair[met], doc[:-1][met] if len(doc) else doc, self.docs), self.counts(doc[:-1][met] if len(doc) else doc) / self.n, _spread(each, self.sent_doc, self.docs),
            of(word >= 3.5), of(word <= 2), self.counts(self.sent_doc, each >= 3.5) / self.m,
        ])

    def in_sentence(self) -> np.ndarray:
        """Whether each word and the next stand in one sentence."""
        return self.sent[:-1] == self.sent[1:]


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about SLICE_CHARS characters, which bounds the working arrays."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


@dataclass
class Lexicon:
    """Terms (words, and pairs of words as a * width + b) with the sum and number of their texts' grades by fold."""

    words: dict[str, int]
    word_sums: np.ndarray
    pairs: np.ndarray
    pair_sums: np.ndarray

    def grades(self, without: tuple[int, ...], middle: float, shrink: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """The shrunken mean grade of every word and pair over the folds not left out; NaN where there is none."""
        keep = [f for f in range(FOLDS) if f not in without]

        def mean(sums: np.ndarray) -> np.ndarray:
            s, n = sums[:, keep].sum(1), sums[:, [FOLDS + f for f in keep]].sum(1)
            return np.where(n >= 1, (s + shrink * middle) / (n + shrink), np.nan)

        return np.append(mean(self.word_sums), np.nan), np.append(mean(self.pair_sums), np.nan)

    def places(self, p: Parsed) -> tuple[np.ndarray, np.ndarray]:
        """The place of every word, and of every word with the next, in the lists of grades; the last place: not known."""
        none = len(self.words)
        kind = np.array([self.words.get(k, none) for k in p.kinds], np.int64)
        word = kind[p.code] if len(kind) else np.zeros(0, np.int64)
        key = word[:-1] * np.int64(none + 1) + word[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        hit = (self.pairs[at] == key) & p.in_sentence() if len(self.pairs) else np.zeros(len(key), bool)
        return word, np.where(hit, at, len(self.pairs))

    def features(self, texts: list[str], grades: list[tuple[np.ndarray, np.ndarray]], middle: float) -> np.ndarray:
        """(grades, texts, features)."""
        out = []
        for some in slices(texts):
            p = Parsed(some)
            word, pair = self.places(p)
            out.append(np.stack([np.hstack([p.plain, p.graded(w[word], q[pair], middle)]) for w, q in grades]))
        return np.concatenate(out, axis=1) if out else np.zeros((len(grades), 0, N_FEATURES))


_EMPTY = Lexicon({}, np.zeros((0, 2 * FOLDS)), np.zeros(0, np.int64), np.zeros((0, 2 * FOLDS)))
N_FEATURES = 0
N_FEATURES = _EMPTY.features(["One two. Three four five."], [_EMPTY.grades((), 3.0)], 3.0).shape[2]


@dataclass
class Model:
    """Term grades, trees over the text's distributions, and the calibration of their sum to the scale."""

    lexicon: Lexicon
    middle: float
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def predict(self, texts: list[str]) -> np.ndarray:
        x = self.lexicon.features(texts, [self.lexicon.grades((), self.middle)], self.middle)[0]
        raw = self.trees.predict(x)
        return np.interp(raw, *self.knots) if len(self.knots[0]) else raw


def graded(documents: DataFrame, labels: DataFrame, key: str, text: str, source: str, level: str, most: int) -> DataFrame:
    """At most ``most`` graded texts with a character in them: key, text, fold (by source), level (the raters' mean)."""
    mean = labels.where(F.col(level).isNotNull()).distinct().groupBy(F.col(key).alias("k")).agg(F.avg(level).alias("level"))
    chosen = F.broadcast(mean.orderBy(F.xxhash64("k"), "k").limit(most))
    fold = F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(FOLDS)).cast("int")
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), fold.alias("fold")).where(has_text(F.col("t")))
    return docs.join(chosen, "k").groupBy("k", "level").agg(F.min(F.struct("t", "fold")).alias("d")).select("k", "level", "d.t", "d.fold")


def has_text(c: Column) -> Column:
    return c.isNotNull() & c.rlike(r"\S")


def lexicon(rows: DataFrame) -> Lexicon:
    """The terms of at least two graded texts; their number is bounded by that of the graded texts' words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for some in slices(list(b["t"])):
                p, y, f = Parsed(some), b["level"].to_numpy(float)[at : at + len(some)], b["fold"].to_numpy(int)[at : at + len(some)]
                at += len(some)
                wide = max(len(p.kinds), 1)
                both = p.in_sentence()
                kinds = np.array([*p.kinds, ""], object)
                for terms, docs in ((p.code, p.doc), ((p.code[:-1] * wide + p.code[1:])[both] + wide, p.doc[:-1][both])):
                    if not len(terms):
                        continue
                    u = np.unique(np.stack([terms, docs], 1), axis=0)  # each term once a text
                    t, place = np.unique(u[:, 0], return_inverse=True)
                    sums = np.zeros((len(t), 2 * FOLDS))
                    np.add.at(sums, (place, f[u[:, 1]]), y[u[:, 1]])
                    np.add.at(sums, (place, FOLDS + f[u[:, 1]]), 1)
                    pair = t >= wide
                    a, c = np.where(pair, (t - wide) // wide, t), np.where(pair, (t - wide) % wide, len(kinds) - 1)
                    yield pd.DataFrame({"a": kinds[a], "b": kinds[c], **{f"c{k}": sums[:, k] for k in range(2 * FOLDS)}})

    columns = [f"c{k}" for k in range(2 * FOLDS)]
    sums = rows.mapInPandas(run, "a string, b string, " + ", ".join(f"{c} double" for c in columns)).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in columns))
    kept = sums.where(sum((F.col(c) for c in columns[FOLDS:]), F.lit(0.0)) >= 2).toPandas().sort_values(["a", "b"], ignore_index=True)
    single = kept["b"] == ""
    words = {w: k for k, w in enumerate(kept.loc[single, "a"])}
    pairs = kept[~single]
    key = np.array([words[a] * (len(words) + 1) + words[b] for a, b in zip(pairs["a"], pairs["b"])], np.int64)
    order = np.argsort(key)
    return Lexicon(words, kept.loc[single, columns].to_numpy(float), key[order], pairs[columns].to_numpy(float)[order])


def _sample(documents: DataFrame, labels: DataFrame, key: str, text: str, source: str, level: str, most_rows: int, depth: int) -> tuple[Lexicon, float, np.ndarray, np.ndarray, dict]:
    """(terms, middle, levels, folds, features): each graded text's features under term grades without its own fold and up
    to ``depth`` others, by the folds left out."""
    rows = graded(documents, labels, key, text, source, level, most_rows).persist()
    try:
        middle = rows.agg(F.avg("level")).first()[0]
        middle = 3.0 if middle is None else float(middle)
        lex = lexicon(rows)
        outs = [c for n in range(1, depth + 2) for c in itertools.combinations(range(FOLDS), n)]
        shared = rows.sparkSession.sparkContext.broadcast((lex, [lex.grades(c, middle) for c in outs]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, grades = shared.value
            for b in batches:
                x = own.features(list(b["t"]), grades, middle)
                fold = b["fold"].to_numpy(int)
                for j, c in enumerate(outs):
                    k = np.flatnonzero(np.isin(fold, c))
                    if not len(k):
                        continue
                    yield pd.DataFrame({"level": b["level"].to_numpy(float)[k], "fold": fold[k], "k": b["k"].astype(str).to_numpy()[k], "without": j, "x": list(x[j, k])})

        data = rows.mapInPandas(run, "level double, fold int, k string, without int, x array<double>").toPandas().sort_values("k")
    finally:
        rows.unpersist()
    base = data.drop_duplicates("k")
    place = {k: i for i, k in enumerate(base["k"])}
    features = {}
    for j, c in enumerate(outs):
        part = data[data["without"] == j]
        x = np.full((len(base), N_FEATURES), np.nan)
        x[[place[k] for k in part["k"]]] = np.array(part["x"].tolist(), float).reshape(len(part), N_FEATURES)
        features[frozenset(c)] = x
    return lex, middle, base["level"].to_numpy(float), base["fold"].to_numpy(int), features


def _held(y: np.ndarray, fold: np.ndarray, features: dict, middle: float, without: frozenset = frozenset()) -> np.ndarray:
    """Predictions of every text outside ``without`` by trees and grades that know neither its fold nor those left out."""
    held = np.full(len(y), middle)
    for f in set(np.unique(fold).tolist()) - without:
        rest = ~np.isin(fold, [*without, f])
        if rest.any():
            x = np.full((len(y), N_FEATURES), np.nan)
            for g in set(np.unique(fold[rest]).tolist()):
                x[fold == g] = features[without | {g}][fold == g]
            held[fold == f] = Trees(rounds=80).fit(x[rest], y[rest]).predict(features[without | {f}][fold == f])
    return held


def train(documents: DataFrame, labels: DataFrame, key: str, text: str, source: str, level: str, most_rows: int = 6000) -> Model:
    """A model from at most ``most_rows`` graded texts.

    Folds are made of whole sources. A text's features use term grades learned without its fold, as for a new source;
    trees trained without a fold predict it, and the isotonic calibration is fitted to these held-out predictions.
    Grades of null are left out, the raters' mean counts; without any grade every text gets the middle of the scale, 3.
    """
    lex, middle, y, fold, features = _sample(documents, labels, key, text, source, level, most_rows, 0)
    knots = isotonic(_held(y, fold, features, middle), y)
    x = np.full((len(y), N_FEATURES), np.nan)
    for f in np.unique(fold):
        x[fold == f] = features[frozenset([int(f)])][fold == f]
    trees = Trees(rounds=80)
    trees.base = middle
    return Model(lex, middle, trees.fit(x, y), knots)


def validate(documents: DataFrame, labels: DataFrame, key: str, text: str, source: str, level: str, most_rows: int = 6000) -> pd.DataFrame:
    """Held-out errors by fold of sources: fold, texts, mean_error, within_half, demanding_right (on the right side of 3.5).

    Strictly held out: term grades, trees and calibration of the model that judges a fold are all learned without it; its
    calibration comes from predictions that are held out once more, within the other folds.
    """
    _, middle, y, fold, features = _sample(documents, labels, key, text, source, level, most_rows, 2)
    out = []
    for f in np.unique(fold).tolist():
        own, rest = fold == f, fold != f
        inner = _held(y, fold, features, middle, frozenset([f]))
        knots = isotonic(inner[rest], y[rest])
        x = np.full((len(y), N_FEATURES), np.nan)
        for g in np.unique(fold[rest]).tolist():
            x[fold == g] = features[frozenset([f, g])][fold == g]
        raw = Trees(rounds=80).fit(x[rest], y[rest]).predict(features[frozenset([f])][own]) if rest.any() else np.full(own.sum(), middle)
        error = (np.interp(raw, *knots) if len(knots[0]) else raw) - y[own]
        out.append((f, int(own.sum()), float(np.abs(error).mean()), float((np.abs(error) <= 0.5).mean()), float(((error + y[own] >= 3.5) == (y[own] >= 3.5)).mean())))
    return pd.DataFrame(out, columns=["fold", "texts", "mean_error", "within_half", "demanding_right"])


def levels(documents: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """The reading level of every text: key, score (calibrated), level (1 to 5).

    One scan with an Arrow-batched stage; the model (bounded by the graded texts' words) is broadcast.
    Defined cases: null, empty and blank texts have null score and level; texts without a word get the level learned for
    such texts; texts of any length are read whole; repeated rows count once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "score": shared.value.predict(list(b["t"]))})

    kind = rows.schema[key].dataType.simpleString()
    read = rows.where(has_text(F.col("t"))).mapInPandas(run, f"`{key}` {kind}, score double")
    none = rows.where(~has_text(F.coalesce("t", F.lit("")))).select(key, F.lit(None).cast("double").alias("score"))
    return read.unionByName(none).distinct().withColumn("level", F.when(F.col("score").isNotNull(), F.least(F.greatest(F.round("score"), F.lit(1)), F.lit(5))).cast("int"))
