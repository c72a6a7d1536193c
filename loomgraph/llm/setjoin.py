"""Exact set-similarity join: the common core of near-duplicate texts and of similar value sets.

Sets are arrays of 64-bit token hashes. Equal sets form a class, named by a 128-bit signature that every task computes
alike, so that copies never multiply work. The join has four steps.

1. One scan counts the tokens in a sketch whose width follows their number (at most 2^24 counters, 32 MB), which orders
   tokens from rare to frequent. The order only has to be the same everywhere for the prefix filter to be exact; the
   sketch's errors cost time, no pairs.
2. Sets of more than LARGE tokens are dealt into virtual sets by their tokens' hash: two sets that overlap by t overlap by
   t in one of these at least. So every set to be joined is short, and what travels with a token stays of fixed size.
3. Each virtual set sends its prefix (the rarest tokens, of which two similar sets share at least one) to the partitions of
   these tokens, packed into binary blocks of (class, size, parity bitmaps) and (token, position). A partition sorts each
   token's list by size bucket and position; a probe skips, by binary search in each bucket, all entries whose position
   already rules the required overlap out, and the bitmaps thin the rest. Tokens whose lists are truly longer than HEAVY
   (counted exactly) are split into pairs of blocks, so no list grows without bound.
4. The pairs left fetch their classes' whole sets and are verified, answers derived from highly similar sets' answers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import materialize

STRIPES = 64
MOST_BITS = 24
HEAVY = 20_000
PER_PART = 1_500_000
LARGE = 128
#: Words of a bitmap, and the tokens from which it has as many again.
WORDS, WIDE = 3, 136
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Sets:
    """Ragged sets: tokens of set k are tokens[start[k]:start[k + 1]], distinct and sorted; row[k] is its row in the batch."""

    row: np.ndarray
    start: np.ndarray
    tokens: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.start)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row)), self.size)

    def signatures(self) -> np.ndarray:
        """(n, 2) 128-bit signatures, independent of the order of tokens."""
        if not len(self.row):
            return np.zeros((0, 2), U)
        parts = [np.add.reduceat(mix(self.tokens ^ U(k)), self.start[:-1]) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        return mix(np.stack(parts, 1) + self.size.astype(U)[:, None])

    def take(self, keep: np.ndarray) -> "Sets":
        size = self.size[keep]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[:-1][keep] - start[:-1], size) + np.arange(start[-1])
        return Sets(self.row[keep], start, self.tokens[at])


def stable(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``order`` sorted further by a non-negative key, stably; keys below 65,536 take one radix pass."""
    k = key[order]
    return order[np.argsort(k.astype(np.uint16) if len(k) and k.max() < 65536 else k, kind="stable")]


def ragged(row: np.ndarray, owner: np.ndarray, tokens: np.ndarray, least: int = 1) -> Sets:
    """Sets from (owner, token) pairs: repeats dropped, sets of fewer than ``least`` tokens left out."""
    order = stable(np.argsort(tokens), owner)
    owner, tokens = owner[order], tokens[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
    owner, tokens = owner[new], tokens[new]
    size = np.bincount(owner, minlength=len(row)) if len(owner) else np.zeros(len(row), np.int64)
    sets = Sets(row, np.concatenate([[0], np.cumsum(size)]), tokens)
    return sets.take(np.flatnonzero(size >= max(1, least)))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort, which is faster here than hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def first_of_each(sig: np.ndarray) -> np.ndarray:
    """Indices of the first row of every distinct signature."""
    return np.sort(np.unique(sig.view("V16").ravel(), return_index=True)[1]) if len(sig) else np.zeros(0, np.int64)


Extract = Callable[[pd.DataFrame], Sets]


def bitmaps(sets: Sets, words: int = WORDS) -> np.ndarray:
    """Parity bitmaps: bit h is the number of tokens hashed to h, modulo 2. Differing bits never exceed differing tokens."""
    bits = 64 * words
    at = sets.owner() * bits + (mix(sets.tokens) % U(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets.row) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets.row), bits), axis=1).view(U)


@dataclass
class Marks:
    """A bitmap for every set, and for those of more than WIDE tokens also the first half of one twice as long; its second
    half is the difference of the two, as tokens of both halves fall on the same bit of the short one."""

    short: np.ndarray
    first: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(sets: Sets) -> "Marks":
        return Marks.joined(bitmaps(sets), bitmaps(sets.take(np.flatnonzero(sets.size > WIDE)), 2 * WORDS)[:, :WORDS], sets.size)

    @staticmethod
    def joined(short: np.ndarray, first: np.ndarray, size: np.ndarray) -> "Marks":
        at = np.full(len(size), -1, np.int64)
        at[size > WIDE] = np.arange(len(first))
        return Marks(short, first, at)

    def differing(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a[k] and b[k] may differ in at most most[k] tokens."""
        apart = self.short[a] ^ self.short[b]
        ok = np.bitwise_count(apart).sum(1, dtype=np.int64) <= most
        k = np.flatnonzero(ok & (self.at[a] >= 0) & (self.at[b] >= 0))
        half = self.first[self.at[a[k]]] ^ self.first[self.at[b[k]]]
        ok[k] = (np.bitwise_count(half).sum(1, dtype=np.int64) + np.bitwise_count(half ^ apart[k]).sum(1, dtype=np.int64)) <= most[k]
        return ok


def needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of sets of sizes a and b at Jaccard t."""
    return np.ceil((a + b) * (t / (1 + t)) - 1e-9).astype(np.int64)


class Lookup:
    """Membership of tokens in sets, by binary search in one sorted array of (set, token rank)."""

    def __init__(self, sets: Sets):
        self.sets, self.size = sets, sets.size
        values, self.rank = np.unique(sets.tokens, return_inverse=True)
        self.wide = np.int64(len(values) + 1)
        self.keys = sets.owner() * self.wide + self.rank  # sorted, as owners ascend and ranks ascend within them

    def inside(self, of: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        k = of * self.wide + ranks
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return self.keys[at] == k

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in ``which`` and rank of every token of these sets."""
        m = self.size[which]
        at = np.repeat(self.sets.start[:-1][which] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        return np.repeat(np.arange(len(which)), m), self.rank[at]

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of sets a[k] and b[k], by looking up the smaller set's tokens."""
        small = self.size[a] <= self.size[b]
        k, r = self.spread(np.where(small, a, b))
        return np.bincount(k, weights=self.inside(np.where(small, b, a)[k], r), minlength=len(a)).astype(np.int64)


def derived_overlaps(sets: Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k], most of them derived where sets are highly similar.

    If y differs from its leader x in few tokens and (x, z) is a pair as well, then
    |y & z| = |x & z| - |(x - y) & z| + |(y - x) & z|, and only the few differing tokens are looked up, once computed
    for all z. Other pairs are counted directly.
    """
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    look, size = Lookup(sets), sets.size
    # leaders: the smallest partner whose set differs in at most a tenth of the tokens; leaders have no leader themselves
    pair = np.minimum(a, b) * np.int64(len(size)) + np.maximum(a, b)
    order = np.argsort(pair)
    by_code = pair[order]
    marks = bitmaps(sets, 4)
    near = np.bitwise_count(marks[a] ^ marks[b]).sum(1, dtype=np.int64) <= 0.1 * np.minimum(size[a], size[b])
    own = np.arange(len(size))
    leader = own.copy()
    np.minimum.at(leader, np.maximum(a[near], b[near]), np.minimum(a[near], b[near]))
    leader = np.where(leader[leader] == leader, leader, own)
    follower, other = np.where(leader[a] != a, a, b), np.where(leader[a] != a, b, a)
    lead = leader[follower]
    known = np.minimum(lead, other) * np.int64(len(size)) + np.maximum(lead, other)
    at = np.minimum(np.searchsorted(by_code, known), n - 1)
    derived = (lead != follower) & (lead != other) & (by_code[at] == known)
    source = order[at]
    derived &= ~derived[source]  # a derived pair's source has to be counted itself
    common = np.zeros(n, np.int64)
    direct, todo = np.flatnonzero(~derived), np.flatnonzero(derived)
    common[direct] = look.overlap(a[direct], b[direct])
    if len(todo):
        common[todo] = common[source[todo]]
        both, index = np.unique(np.stack([follower[todo], lead[todo]], 1), axis=0, return_inverse=True)
        index = index.ravel()
        for mine, theirs, sign in ((0, 1, 1), (1, 0, -1)):
            k, r = look.spread(both[:, mine])
            only = ~look.inside(both[:, theirs][k], r)
            k, r = k[only], r[only]
            m = np.bincount(k, minlength=len(both))
            each = m[index]
            p = np.repeat(np.arange(len(todo)), each)
            q = np.repeat((np.cumsum(m) - m)[index] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            hits = np.bincount(p, weights=look.inside(other[todo][p], r[q]), minlength=len(todo))
            common[todo] += sign * hits.astype(np.int64)
    return common


def coded(counts: np.ndarray | int) -> np.ndarray:
    """Counts on a logarithmic scale of 16 bits, in the same order."""
    return np.minimum(np.round(np.log2(1 + np.asarray(counts, np.float64)) * 2048), 65535).astype(np.uint16)


def sketch_bits(tokens: float) -> int:
    """The sketch has a counter for 16 tokens, but 2^16 at least and 2^MOST_BITS at most."""
    return min(MOST_BITS, max(16, math.ceil(math.log2(max(tokens, 1) / 16))))


def cells(tokens: np.ndarray, size: int) -> np.ndarray:
    """The counter of each token in a sketch of ``size`` counters, a power of two."""
    return (tokens >> U(64 - (size - 1).bit_length())).astype(np.int64)


def scan(records: DataFrame, key: str, extract: Extract, bits: int) -> DataFrame:
    """One pass: (kind 0) each key with its class signature and set size; (kind 1) stripes of the partition's token counts."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = None
        for b in batches:
            sets = extract(b)
            sig = sets.signatures()
            once = sets.take(first_of_each(sig))
            if counts is None:
                counts = np.zeros(1 << bits, np.uint32)
            at, n = np.unique(cells(once.tokens, len(counts)), return_counts=True)
            counts[at] += n.astype(np.uint32)
            s = sig.view(np.int64)
            yield pd.DataFrame({"kind": 0, key: b[key].to_numpy()[sets.row], "hi": s[:, 0], "lo": s[:, 1], "size": sets.size, "counts": None})
        if counts is not None:
            stripes = np.split(np.minimum(counts, 65535).astype(np.uint16), STRIPES)
            yield pd.DataFrame({"kind": 1, key: None, "hi": range(STRIPES), "lo": 0, "size": 0, "counts": [zlib.compress(s.tobytes(), 1) for s in stripes]})

    return records.mapInPandas(run, f"kind int, `{key}` {kind}, hi long, lo long, size long, counts binary")


def sketch(scanned: DataFrame, bits: int) -> np.ndarray:
    """The summed token counts, coded in 16 bits: 2^bits of them, 32 MB at most."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for stripe, raw in zip(b["hi"], b["counts"]):
                part = np.frombuffer(zlib.decompress(raw), np.uint16)
                total[stripe] = total.get(stripe, 0) + part.astype(np.uint32)
        yield pd.DataFrame({"stripe": list(total), "counts": [coded(c).tobytes() for c in total.values()]})

    rows = scanned.where("kind = 1").select("hi", "counts").repartition(F.col("hi")).mapInPandas(add, "stripe long, counts binary").collect()
    out = np.zeros(1 << bits, np.uint16)
    width = len(out) // STRIPES
    for stripe, counts in rows:
        out[stripe * width : (stripe + 1) * width] = np.frombuffer(counts, np.uint16)
    return out


def members(scanned: DataFrame, key: str) -> DataFrame:
    """(key, hi, lo, size), each key once per different set."""
    return scanned.where("kind = 0").select(key, "hi", "lo", "size").distinct()


def level_of(size: np.ndarray) -> np.ndarray:
    """How often a set of this size is dealt in four: as often as leaves at most LARGE tokens on average."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / LARGE) / 2 - 1e-9)).astype(np.int64)


def virtual(sets: Sets, t: float) -> tuple[Sets, np.ndarray]:
    """Virtual sets (row: the set they come from) and the level of each.

    A set is dealt at its own level, and at the level of the smallest set that it could be similar to: the smaller set of a
    similar pair decides the level at which they meet.
    """
    own = level_of(sets.size)
    low = level_of(np.ceil(sets.size * t - 1e-9))
    all_ = np.arange(len(own))
    which, level = np.concatenate([all_, all_[low < own]]), np.concatenate([own, low[low < own]])
    dealt = sets.take(which)
    owner = dealt.owner()
    first = np.cumsum(4**level) - 4**level
    hand = first[owner] + (mix(dealt.tokens ^ U(0xA0761D6478BD642F)) % (4**level)[owner].astype(U)).astype(np.int64)
    order = np.argsort(hand, kind="stable")
    size = np.bincount(hand, minlength=int((4**level).sum()))
    some = np.flatnonzero(size)
    start = np.concatenate([[0], np.cumsum(size[some])])
    back = np.repeat(np.arange(len(which)), 4**level)[some]
    return Sets(which[back], start, dealt.tokens[order]), level[back]


def prefixes(sets: Sets, codes: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, token, position, coded count) of the prefixes in the order from rare to frequent; tokens of one set are left out."""
    owner = sets.owner()
    freq = codes[cells(sets.tokens, len(codes))]
    order = stable(stable(np.arange(len(owner)), freq), owner)  # equal counts: by token
    owner, tokens, freq = owner[order], sets.tokens[order], freq[order]
    pos = np.arange(len(owner)) - sets.start[:-1][owner]
    size = sets.size
    length = size - np.ceil(size * t - 1e-9).astype(np.int64) + 1
    keep = (pos < length[owner]) & (freq > coded(1))
    return owner[keep], tokens[keep], pos[keep], freq[keep]


def _postings(sets: Sets, codes: np.ndarray, t: float) -> tuple[Sets, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The virtual sets, and (virtual set, list name, position, coded count) of their prefixes; a list is a token at a level."""
    parts, level = virtual(sets, t)
    owner, token, pos, freq = prefixes(parts, codes, t)
    return parts, owner, mix(token + level[owner].astype(U) * U(0xE7037ED1A0B428DB)), pos, freq


def posting_estimate(size: Column, t: float) -> Column:
    """At least the number of a set's postings."""
    once = size - F.ceil(size * t) + 1
    return F.when(size <= LARGE, once).otherwise(2 * (once + size / (LARGE / 4) + 4))


def heavy_lists(records: DataFrame, extract: Extract, codes, t: float, heavy: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(names, lengths) of the lists with more than ``heavy`` classes, by an exact count.

    Only tokens whose sketched count exceeds ``heavy`` come into question, as the sketch never counts too few; where there is
    none, nothing is read. The result has at most postings / heavy entries.
    """
    limit = coded(heavy)
    if not (codes.value > limit).any():
        return np.zeros(0, U), np.zeros(0, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = extract(b)
            sig = sets.signatures()
            first = first_of_each(sig)
            sets, sig = sets.take(first), sig[first]
            parts, owner, name, _, freq = _postings(sets, codes.value, t)
            k = np.flatnonzero(freq > limit)
            yield pd.DataFrame({"name": name[k].view(np.int64), "lo": sig[parts.row[owner[k]], 1].view(np.int64)})

    rows = records.mapInPandas(run, "name long, lo long").groupBy("name").agg(F.count_distinct("lo").alias("n")).where(F.col("n") > heavy).collect()
    name, n = np.array([r[0] for r in rows], np.int64).view(U), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(name)
    return name[order], n[order]


def spread(owner: np.ndarray, name: np.ndarray, pos: np.ndarray, ids: np.ndarray, names: np.ndarray, lengths: np.ndarray, heavy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings with those of heavy lists copied to the pairs of blocks that the set's block (by its id) is part of."""
    if not len(names) or not len(name):
        return owner, name, pos
    at = np.minimum(np.searchsorted(names, name), len(names) - 1)
    hot = names[at] == name
    k = np.flatnonzero(hot)
    n = -(-lengths[at[k]] // heavy)
    copy = np.repeat(k, n)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
    block = (ids[owner[copy]] % np.repeat(n, n).astype(U)).astype(np.int64)
    lo, hi = np.minimum(block, other).astype(U), np.maximum(block, other).astype(U)
    split = mix(name[copy] + lo * U(0x9E3779B97F4A7C15) + mix(hi))
    return np.concatenate([owner[~hot], owner[copy]]), np.concatenate([name[~hot], split]), np.concatenate([pos[~hot], pos[copy]])


def fitting(x: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(arrays), *(v for a in arrays for v in (len(a), a.itemsize))], np.int32).tobytes(), *(a.tobytes() for a in arrays)])


def unpack(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    shape = np.frombuffer(raw, np.int32, 2 * n, 4).reshape(n, 2)
    out, at = [], 4 + 8 * n
    for count, width in shape.tolist():
        out.append(np.frombuffer(raw, f"u{width}", count, at))
        at += count * width
    return out


def blocks(records: DataFrame, extract: Extract, codes, heavy: tuple[np.ndarray, np.ndarray], t: float, parts: int, limit: int = HEAVY) -> DataFrame:
    """Packed prefixes by partition: of each virtual set met there the class (64 bits of its name), size and bitmaps, then the
    postings: list (32 bits; lists that coincide cost time only), set within the block, position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = extract(b)
            sig = sets.signatures()
            first = first_of_each(sig)
            sets, ids = sets.take(first), sig[first, 1]
            short, owner, name, pos, _ = _postings(sets, codes.value, t)
            ids = ids[short.row]
            owner, name, pos = spread(owner, name, pos, ids, *heavy, limit)
            part = (name % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            owner, name, pos, part = owner[order], (name[order] >> U(32)).astype(np.uint32), pos[order], part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            marks, size = Marks.of(short), short.size
            out = []
            for q in np.flatnonzero(np.diff(ends)).tolist():
                s = slice(ends[q], ends[q + 1])
                used, local = np.unique(owner[s], return_inverse=True)
                wide = marks.at[used]
                out.append((q, pack([ids[used], fitting(size[used]), marks.short[used].ravel(), marks.first[wide[wide >= 0]].ravel(), name[s], fitting(local), fitting(pos[s])])))
            yield pd.DataFrame(out, columns=["part", "block"])

    return records.mapInPandas(run, "part int, block binary")


def probe(size: np.ndarray, token: np.ndarray, rec: np.ndarray, pos: np.ndarray, t: float, slice_pairs: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of sets that share a token at positions that allow the overlap needed at t; size[y] <= size[x]."""
    bucket = np.floor(np.log(size) / np.log(1.05)).astype(np.int64)
    tokens, tid = np.unique(token, return_inverse=True)
    order = np.lexsort((pos, bucket[rec], tid))
    tid, rec, pos = tid[order], rec[order], pos[order].astype(np.int64)
    buckets = int(bucket.max()) + 2
    group = tid * buckets + bucket[rec]  # ascending: a token's lists, one for each size bucket, each by position
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    keys = group[starts]
    ends = np.concatenate([starts[1:], [len(group)]])
    largest = np.maximum.reduceat(size[rec], starts)
    span = int(pos.max()) + 2
    place = group * span + pos
    x, lx = np.arange(len(rec)), size[rec].astype(np.int64)
    low = np.floor(np.log(np.maximum(lx * t - 1e-9, 1)) / np.log(1.05)).astype(np.int64)
    first = np.searchsorted(keys, tid * buckets + np.maximum(low, 0))
    last = np.searchsorted(keys, group, side="right")
    each = last - first
    total = np.cumsum(each)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + slice_pairs, side="right")))
        n = each[lo:hi]
        p = np.repeat(x[lo:hi], n)
        g = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        most = np.minimum(largest[g], lx[p])
        allowed = most - needed(lx[p], most, t)  # positions beyond it can't be met by any set of the bucket
        stop = np.searchsorted(place, keys[g] * span + np.maximum(allowed, -1) + 1)
        m = np.maximum(np.minimum(stop, ends[g]) - starts[g], 0)
        m[lx[p] - pos[p] < needed(lx[p], np.ceil(lx[p] * t - 1e-9), t)] = 0
        # the lists may be long: again in slices
        reach = np.cumsum(m)
        k = 0
        while k < len(m):
            e = max(k + 1, int(np.searchsorted(reach, (reach[k - 1] if k else 0) + slice_pairs, side="right")))
            mm = m[k:e]
            pp = np.repeat(p[k:e], mm)
            yy = np.repeat(starts[g[k:e]] - (np.cumsum(mm) - mm), mm) + np.arange(mm.sum())
            k = e
            a, b = rec[pp], rec[yy]
            sa, sb = lx[pp], lx[yy]
            need = needed(sa, sb, t)
            ok = ((sb < sa) | ((sb == sa) & (b < a))) & (1 + np.minimum(sa - pos[pp], sb - pos[yy]) - 1 >= need) & (sb >= sa * t - 1e-9)
            if ok.any():
                yield a[ok], b[ok]
        lo = hi


def merge(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, Marks, np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, bitmaps) of the sets of all blocks, and (list, set, position) of the postings, each once."""
    got = [unpack(x) for x in found]
    ids, size, short, first, token = (np.concatenate([g[k] for g in got]) for k in range(5))
    base = np.cumsum([0, *(len(g[0]) for g in got)])
    rec = np.concatenate([g[5].astype(np.int64) + o for g, o in zip(got, base)])
    pos = np.concatenate([g[6].astype(np.int64) for g in got])
    # copies of a class send the same postings from several batches
    order = np.lexsort((ids[rec], token))
    token, rec, pos = token[order], rec[order], pos[order]
    once = np.ones(len(token), bool)
    once[1:] = (token[1:] != token[:-1]) | (ids[rec[1:]] != ids[rec[:-1]])
    return ids, size.astype(np.int64), Marks.joined(short.reshape(-1, WORDS), first.reshape(-1, WORDS), size), token[once], rec[once], pos[once]


def thinned(found: list[bytes], t: float) -> np.ndarray:
    """(n, 2) classes of the pairs that positions and bitmaps leave open, each once, the smaller first."""
    ids, size, marks, token, rec, pos = merge(found)
    seen = [np.zeros((0, 2), np.int64)]
    n = np.int64(len(size))
    for a, b in probe(size, token, rec, pos, t):
        code = distinct(a * n + b)
        a, b = code // n, code % n
        most = size[a] + size[b] - 2 * needed(size[a], size[b], t)
        ok = marks.differing(a, b, most) & (ids[a] != ids[b])
        pair = np.sort(np.stack([ids[a[ok]], ids[b[ok]]], 1).view(np.int64), axis=1)
        seen.append(pair)
    return np.unique(np.concatenate(seen), axis=0)


def class_pairs(records: DataFrame, extract: Extract, t: float, codes: np.ndarray, postings: int, heavy: int = HEAVY, per_part: int = PER_PART) -> DataFrame:
    """Pairs (a, b) of 64-bit class names, a before b, each once: all pairs with Jaccard of at least t and a few others."""
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(codes)
    lists = heavy_lists(records, extract, shared, t, heavy)
    copies = int((lists[1] * (-(-lists[1] // heavy) - 1)).sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(int(postings) + copies) // per_part))
    packed = blocks(records, extract, shared, lists, t, parts, heavy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [x for b in batches for x in b["block"]]
        if found:
            pairs = thinned(found, t)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return packed.repartitionById(parts, "part").mapInPandas(run, "a long, b long").distinct()


def similar_classes(records: DataFrame, key: str, extract: Extract, tokens: Column, t: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of every set (key, hi, lo, size), and the pairs of different classes with a Jaccard of at
    least t (a_hi, a_lo, b_hi, b_lo, similarity), each once. tokens: about the number of a record's tokens."""
    bits = sketch_bits(records.agg(F.sum(tokens)).first()[0] or 0)
    scanned = materialize(scan(records, key, extract, bits))
    postings = scanned.where("kind = 0").agg(F.sum(posting_estimate(F.col("size"), t))).first()[0] or 0
    candidates = materialize(class_pairs(records, extract, t, sketch(scanned, bits), postings))
    ends = candidates.select(F.col("a").alias("id")).union(candidates.select(F.col("b").alias("id")))
    return members(scanned, key), verified(candidates, sets_of(records, extract, marked(ends, 2 * candidates.count())), t)


def marked(ids: DataFrame, n: int) -> np.ndarray:
    """A bit filter with a bit for each id: 16 bits for each of the n ids, at most 2^27 (16 MB) in all."""
    bits = min(27, max(12, math.ceil(math.log2(16 * max(n, 1)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            held[b["id"].to_numpy().view(U) >> U(64 - bits)] = True
        packed = np.packbits(held)
        yield pd.DataFrame({"k": range(16), "bits": [zlib.compress(x.tobytes(), 1) for x in np.split(packed, 16)]})

    def either(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b["k"], b["bits"]):
                part = np.frombuffer(zlib.decompress(raw), np.uint8)
                total[k] = total[k] | part if k in total else part
        yield pd.DataFrame({"k": list(total), "bits": [x.tobytes() for x in total.values()]})

    rows = ids.mapInPandas(run, "k int, bits binary").repartition(F.col("k")).mapInPandas(either, "k int, bits binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, x in rows:
        out[k * len(out) // 16 : (k + 1) * len(out) // 16] = np.frombuffer(x, np.uint8)
    return out


def sets_of(records: DataFrame, extract: Extract, bits: np.ndarray) -> DataFrame:
    """(hi, lo, tokens) of the classes that the bit filter holds, each once."""
    shared = records.sparkSession.sparkContext.broadcast(bits)
    width = (8 * len(bits) - 1).bit_length()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = extract(b)
            sig = sets.signatures()
            first = first_of_each(sig)
            at = (sig[first, 1] >> U(64 - width)).astype(np.int64)
            first = first[(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            sets, s = sets.take(first), sig[first].view(np.int64)
            yield pd.DataFrame({"hi": s[:, 0], "lo": s[:, 1], "tokens": [sets.tokens[i:j].tobytes() for i, j in zip(sets.start[:-1], sets.start[1:])]})

    return records.mapInPandas(run, "hi long, lo long, tokens binary").dropDuplicates(["hi", "lo"])


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs whose sets have a Jaccard of at least t, with their similarity. Sets come by two joins on the 64-bit name;
    should two classes share it, both are compared."""
    a, b = (sets.select(F.col("lo").alias(p), F.col("hi").alias(f"{p}_hi"), F.col("tokens").alias(f"{p}_tokens")) for p in "ab")
    rows = pairs.join(a, "a").join(b, "b").withColumnsRenamed({"a": "a_lo", "b": "b_lo"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            raw = [*p["a_tokens"], *p["b_tokens"]]
            sig = np.concatenate([p[["a_hi", "a_lo"]].to_numpy(), p[["b_hi", "b_lo"]].to_numpy()])
            _, first, inverse = np.unique(np.ascontiguousarray(sig).view("V16").ravel(), return_index=True, return_inverse=True)
            arrays = [np.frombuffer(raw[k], U) for k in first]
            size = np.array([len(x) for x in arrays])
            s = Sets(np.arange(len(first)), np.concatenate([[0], np.cumsum(size)]), np.concatenate(arrays))
            a, b = inverse[: len(p)], inverse[len(p) :]
            common = derived_overlaps(s, a, b)
            ok = common >= needed(size[a], size[b], t)
            out = p.loc[ok, ["a_hi", "a_lo", "b_hi", "b_lo"]]
            yield out.assign(similarity=(common / (size[a] + size[b] - common))[ok])

    return rows.mapInPandas(run, "a_hi long, a_lo long, b_hi long, b_lo long, similarity double")
