import random

import numpy as np
import pandas as pd
import pytest

from loomgraph.llm import neighbours, topn


def test_top_n_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot", round(rng.random(), 2), f"t{i:05d}") for i in range(6000)] + [("ties", 0.5, f"t{i:05d}") for i in range(2000)] + [(f"g{i % 40}", rng.random(), f"t{i:05d}") for i in range(300)]
    rows += rows[:500] + [("hot", None, "a"), ("hot", float("nan"), "a"), (None, 1.0, "a"), ("hot", 1.0, None), ("inf", float("inf"), "a"), ("inf", 1.0, "b"), ("two", 1.0, "x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "key string, w double, id string, g string, rank int")
    want = {}
    for g, s, t in {r for r in rows if None not in r and r[1] == r[1]}:
        want.setdefault(g, []).append((-s, t))
    want = {(g, t, k) for g, v in want.items() for k, (_, t) in enumerate(sorted(v)[:5], 1)}
    for least in (100, 10**9):
        got = topn.top_n(df, "key", "w", "id", 5, least_rows=least)
        assert {(r.key, r.id, r["rank"]) for r in got.collect()} == want
    assert topn.top_n(df.where("false"), "key", "w", "id").count() == 0


def exact(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    np.fill_diagonal(sims, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -sims[n]))[:k]] for n, i in enumerate(ids)}


@pytest.mark.parametrize("n", [400, 26_000])
def test_recall_against_brute_force(spark, n):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, n)] + 0.7 * rng.normal(size=(n, 16))
    ids = np.array([f"v{i:06d}" for i in range(n)])
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "v": [v.tolist() for v in x], "k": 1}), "id string, v array<double>, k int")
    got = {}
    for r in neighbours.nearest(df, "id", "v", k=5, dim=16).collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    assert len(got) == n and all(len(v) == 5 for v in got.values())
    some = rng.choice(n, 200, replace=False)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in some:
        s = u @ u[i]
        s[i] = -9
        hits += len(got[ids[i]] & set(ids[np.argsort(-s)[:5]]))
    assert hits / 1000 >= 0.95


def test_every_cell_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8))
    ids = np.array([f"v{i:04d}" for i in range(700)])
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "v": [v.tolist() for v in x]}), "id string, v array<double>")
    got = {}
    for r in neighbours.nearest(df, "id", "v", k=5, dim=8, cell=60, leaf=16, exact=True).collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    want = exact(x, ids, 6)
    wrong = [i for i in ids if got[i] != set(want[i][:5])]
    assert len(wrong) <= 3 and all(got[i] <= set(want[i]) for i in wrong)  # half precision between cells


def test_the_stopping_test_keeps_what_it_promises():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = neighbours.freedom(x)
    assert 30 < d <= 32
    index = neighbours.Block(x, 64)
    best, at = np.full((100, 6), -2.0, np.float32), np.zeros((100, 6), np.int64)
    done = index.search(index.vectors[:100], best, at, d, 4.0)
    true = np.sort(index.vectors[:100] @ index.vectors.T, 1)[:, ::-1][:, :6]
    assert np.isclose(best, true, atol=1e-5).mean() > 0.97 and done < 0.9 * 100 * 4000
    best[:] = -2
    index.search(index.vectors[:100], best, at, d, np.inf)
    assert np.allclose(best, true, atol=1e-5)


def test_damaged_and_repeated_vectors(spark):
    good = {f"a{i}": [1.0, float(i)] for i in range(4)}
    copies = {f"c{i:02d}": [2.0, 2.0] for i in range(30)}
    rows = [*good.items(), *copies.items(), ("a0", [1.0, 0.0]), ("n", None), ("e", []), ("s", [1.0]), ("z", [0.0, 0.0]), ("q", [float("nan"), 1.0]), ("h", [None, 1.0]), ("i", [float("inf"), 1.0])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "id string, v array<double>, found string")
    got = {}
    for r in neighbours.nearest(df, "id", "v", k=5, dim=2).collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    assert set(got) == set(good) | set(copies)
    assert got["c00"] == ["a1", "c01", "c02", "c03", "c04"] and got["c29"] == ["a1", "c00", "c01", "c02", "c03"]
    assert neighbours.nearest(df.where("false"), "id", "v", dim=2).count() == 0
    few = neighbours.nearest(df.where("id in ('a0', 'a1')"), "id", "v", k=5, dim=2).collect()
    assert sorted((r.id, r.neighbour_id) for r in few) == [("a0", "a1"), ("a1", "a0")]
