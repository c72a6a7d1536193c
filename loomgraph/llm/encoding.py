"""Exact byte-pair encoding by per-prefix dynamic programming."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; every operator takes it as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pre-tokenization pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes a word's bytes: for every prefix, the one token that ends the prefix's own encoding.

    Of the tokens that are suffixes of a prefix (found by walking a suffix automaton: a trie of the reversed tokens,
    read backwards from the prefix's end), exactly one forms a compatible pair with the last token of what is left;
    two tokens are compatible when encoding their concatenation gives just these two. Following the stored tokens
    back from the word's end gives the encoding.
    """

    def __init__(self, path: str, remember: int = 500_000):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.trie: dict = {}
        for t, r in self.rank.items():
            node = self.trie
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[-1] = r
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r in sorted(self.bytes_of):
            t = self.bytes_of[r]
            if len(t) > 1:
                # all merges of lower rank are known here, so the token's own encoding has its two parts
                whole = self._encode(t, below=r)
                if len(whole) == 2:
                    self.parts[r] = (whole[0], whole[1])
                    self.joined[whole[0], whole[1]] = r
        self.known: dict[str, list[int]] = {}
        self.remember = remember
        self.words = regex.compile(PATTERN).findall

    def compatible(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether no merge across the border between a and b would come before those that build a and b."""
        joined, parts, limit = self.joined, self.parts, below
        while True:
            ab = joined.get((a, b))
            if ab is not None and ab < limit:
                return False
            # undo whichever of the two was built last; a border merge had to come before that
            pa, pb = parts.get(a), parts.get(b)
            if pa is not None and (pb is None or a > b):
                limit, a = a, pa[1]
            elif pb is not None:
                limit, b = b + 1, pb[0]
            else:
                return True

    def _encode(self, word: bytes, below: int = 1 << 60) -> list[int]:
        n = len(word)
        last: list[int] = [-1] * (n + 1)
        size: list[int] = [0] * (n + 1)
        for end in range(1, n + 1):
            node, at = self.trie, end
            while at > 0:
                node = node.get(word[at - 1])
                if node is None:
                    break
                at -= 1
                r = node.get(-1)
                if r is None or r >= below or (end - at > 1 and r not in self.parts):
                    continue
                if at == 0 or self.compatible(last[at], r, below):
                    last[end], size[end] = r, end - at
                    break
            if last[end] < 0:
                raise ValueError("the vocabulary lacks a byte")
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for w in self.words(text):
            ids = known.get(w)
            if ids is None:
                raw = w.encode("utf-8", "surrogatepass")
                r = self.rank.get(raw)
                ids = [r] if r is not None and (len(raw) == 1 or r in self.parts) else self._encode(raw)
                if len(known) >= self.remember:
                    known.clear()
                if len(w) <= 64:
                    known[w] = ids
            out += ids
        return out


def encoder(folder: str, name: str) -> Encoder:
    """One encoder per worker process."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_texts(items: DataFrame, key: str, text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """Token ids of every text, without special tokens (their strings are ordinary text).

    One shuffle of keys and texts, so that repeated rows count once and are encoded once, then an Arrow-batched stage. Defined cases: a null or empty
    text has the empty list; blanks are ordinary text; texts of any length are encoded whole in time linear in their
    length; equal keys with different texts come out separately. Result: key, ids array<int>.
    """
    rows = items.select(F.col(key), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(folder, name)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [e.encode(t) if isinstance(t, str) and t else [] for t in b["text"]]})

    return rows.distinct().mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(items: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The keys and n_tokens of every text; null and empty texts have 0."""
    rows = items.select(*keys, F.col(text).alias("text"))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(folder, name)
        for s in batches:
            yield pd.Series([len(e.encode(t)) if isinstance(t, str) and t else 0 for t in s], dtype="int64")

    return rows.select(*keys, count("text").alias("n_tokens"))
