import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import neardup, setjoin, setpairs


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def shingles(t, k, least):
    w = words(t)
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= least else set()


def brute(sets, t):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def make_texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(n):
        if texts and rng.random() < 0.6:
            w = words(texts[rng.choice(list(texts))])
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(15, 60) if rng.random() < 0.9 else 400)]
        texts[f"c{k:03d}"] = " ".join(w) or "x"
    return texts


def test_shingles_match_the_definition():
    texts = ["The Cat, the cat-the CAT é the cat the cat", "a b c", None, "", "straße x y z İx K9 and more words here"]
    sets = setjoin.Sets(*[getattr(neardup.shingle_sets(texts, 3, 3), f) for f in ("row", "start", "tokens")])
    assert [(int(r), int(n)) for r, n in zip(sets.row, sets.size)] == [(k, len(shingles(t, 3, 3))) for k, t in enumerate(texts) if shingles(t, 3, 3)]


def test_near_duplicates_against_brute_force(spark):
    texts = make_texts(140, 5)
    rows = [(k, t, 1) for k, t in texts.items()] + [("c000", texts["c000"], 1), ("n1", None, 1), ("n2", "", 1), ("n3", "too few words", 1), ("n4", "  \n", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, hi int").repartition(5)
    members, links = neardup.similar_texts(df, "chunk_id", "text", 0.6, 3, 20)
    got = {(r.a, r.b) for r in neardup.expanded(members, "chunk_id", links, "a", "b").collect()}
    want = brute({k: shingles(t, 3, 20) for k, t in texts.items()}, 0.6)
    assert got == want and len(want) > 20
    groups = {r.chunk_id: r.group_id for r in neardup.groups(members, "chunk_id", links).collect()}
    assert set(groups) == {k for k, t in texts.items() if shingles(t, 3, 20)}
    for a, b in want:
        assert groups[a] == groups[b] <= a


def test_no_texts(spark):
    df = spark.createDataFrame([], "k string, t string")
    members, links = neardup.similar_texts(df, "k", "t")
    assert members.count() == 0 and links.count() == 0
    assert neardup.groups(members, "k", links).count() == 0


def test_copies_stay_one_class(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(3000).selectExpr("cast(id as string) k", f"'{text}' t").unionByName(spark.createDataFrame([("x", text + " end")], "k string, t string"))
    members, links = neardup.similar_texts(df, "k", "t")
    assert links.count() == 1 and members.select("hi", "lo").distinct().count() == 2
    assert neardup.groups(members, "k", links).select("group_id").distinct().count() == 1


def hashed(lists):
    size = np.array([len(x) for x in lists], np.int64)
    return setjoin.ragged(np.arange(len(size)), np.repeat(np.arange(len(size)), size), setjoin.mix(np.concatenate(lists).astype(np.int64).view(np.uint64)))


def extract_h(b):
    return hashed(list(b["h"]))


def named(sets):
    """The tokens of every class by its 64-bit name."""
    sig = sets.signatures()[:, 1].view(np.int64)
    return {int(n): set(sets.tokens[i:j].tolist()) for n, i, j in zip(sig, sets.start[:-1], sets.start[1:])}


class Value:
    def __init__(self, value):
        self.value = value


def test_heavy_lists_are_split_by_exact_counts(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"k{i:03d}", ["hot", "warm", *rng.sample("abcdefghij", 3)]) for i in range(120)], "k string, v array<string>")
    records = df.select("k", F.array_sort(F.transform("v", lambda x: F.xxhash64(x))).alias("h")).repartition(3)
    sets = extract_h(records.toPandas())
    classes = named(sets)
    codes = setjoin.coded(np.bincount(setjoin.cells(sets.tokens, 1 << 16), minlength=1 << 16))
    names, lengths = setjoin.heavy_lists(records, extract_h, Value(codes), 0.6, heavy=7)
    assert len(names) and lengths.min() > 7
    want = brute(classes, 0.6)
    got = {tuple(r) for r in setjoin.class_pairs(records, extract_h, 0.6, codes, 400, heavy=7, per_part=50).collect()}
    assert want and want <= got
    checked = setjoin.verified(spark.createDataFrame(sorted(got), "a long, b long"), setjoin.sets_of(records, extract_h, np.full(512, 255, np.uint8)), 0.6)
    assert {tuple(sorted((r.a_lo, r.b_lo))) for r in checked.collect()} == want


def test_a_crowded_sketch_copies_nothing(spark):
    """Counters that are far too high order tokens badly, but only truly long lists are split."""
    rng = np.random.default_rng(3)
    records = spark.createDataFrame([(i, rng.choice(3000, 40, replace=False).tolist()) for i in range(300)], "k long, h array<long>")
    sets = extract_h(records.toPandas())
    counts = np.bincount(setjoin.cells(sets.tokens, 1 << 16), minlength=1 << 16)
    for factor in (1, 10_000):
        codes = setjoin.coded(counts * factor)
        assert not len(setjoin.heavy_lists(records, extract_h, Value(codes), 0.6)[0])
    short, owner, name, pos, _ = setjoin._postings(sets, setjoin.coded(counts * 10_000), 0.6)
    ids = sets.signatures()[:, 1][short.row]
    assert len(setjoin.spread(owner, name, pos, ids, *setjoin.heavy_lists(records, extract_h, Value(codes), 0.6), setjoin.HEAVY)[0]) == len(owner)


def test_large_sets_meet_in_virtual_sets(spark):
    rng = np.random.default_rng(5)
    lists = []
    for base in (90, 127, 130, 300, 500, 515, 900, 2100):
        own = rng.choice(100_000, base, replace=False)
        for keep in (1.0, 0.95, 0.79, 0.62, 0.55):
            lists.append(own[: int(base * keep)])
            other = own.copy()
            other[: int(base * (1 - keep) * 0.6)] = rng.integers(200_000, 900_000, int(base * (1 - keep) * 0.6))
            lists.append(np.unique(other))
    sets = hashed(lists)
    assert setjoin.level_of(sets.size).max() == 3
    parts, level = setjoin.virtual(sets, 0.6)
    for at in (0, 1, 2, 3):  # at each level a set's virtual sets hold its tokens once
        for k in np.unique(parts.row[level == at]):
            mine = [parts.tokens[parts.start[v] : parts.start[v + 1]] for v in np.flatnonzero((parts.row == k) & (level == at))]
            assert (np.sort(np.concatenate(mine)) == np.sort(sets.tokens[sets.start[k] : sets.start[k + 1]])).all()
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(lists)], "k long, h array<long>").repartition(4)
    _, links = setjoin.similar_classes(df, "k", extract_h, F.size("h"), 0.6)
    got = {tuple(sorted((r.a_lo, r.b_lo))) for r in links.collect()}
    assert got == brute(named(sets), 0.6) and len(got) > 50


def test_derived_overlaps():
    rng = np.random.default_rng(1)
    base = rng.choice(5000, 200, replace=False)
    arrays = []
    for k in range(30):
        own = base.copy()
        own[rng.integers(0, 200, k % 6)] = rng.integers(5000, 9000, k % 6)
        arrays.append(np.unique(own if k % 3 else rng.choice(5000, 150)))
    size = np.array([len(a) for a in arrays])
    sets = setjoin.Sets(np.arange(30), np.concatenate([[0], np.cumsum(size)]), setjoin.mix(np.concatenate(arrays).astype(np.uint64)))
    sets = setjoin.ragged(sets.row, sets.owner(), sets.tokens)
    a, b = map(np.array, zip(*itertools.combinations(range(30), 2)))
    assert (setjoin.derived_overlaps(sets, a, b) == [len(np.intersect1d(arrays[i], arrays[j])) for i, j in zip(a, b)]).all()


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(4)
    values = [f"v{k}" for k in range(25)]
    lists = {f"r{k:03d}": rng.sample(values[: 8 if k % 3 else 25], rng.randint(2, 6)) for k in range(150)}
    rows = [(k, [*(v.upper() + " " if rng.random() < 0.3 else v for v in vs), None, vs[0]], "x") for k, vs in lists.items()]
    rows += [("n1", None, "x"), ("n2", [], "x"), ("n3", [None], "x"), rows[0], ("long", [f"v{k}" for k in range(5000)], "x"), ("long2", [f"v{k}" for k in range(4000)], "x")]
    df = spark.createDataFrame(rows, "id string, vs array<string>, size string").repartition(4)
    members, links = setpairs.similar_sets(df, "id", F.col("vs"), 0.6, 3)
    got = {(r.a, r.b) for r in neardup.expanded(members, "id", links, "a", "b").collect()}
    sets = {k: set(v) if len(set(v)) >= 3 else set() for k, v in lists.items()} | {"long": {f"v{k}" for k in range(5000)}, "long2": {f"v{k}" for k in range(4000)}}
    want = brute(sets, 0.6)
    assert got == want and ("long", "long2") in got
    links_of = {r.id: r.links for r in setpairs.link_counts(members, "id", links).collect()}
    degree = {k: 0 for k, s in sets.items() if s}
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    assert links_of == degree
