"""Most similar vectors for every vector: cells around centres, visited until a chi-square stopping test holds."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import setjoin as J
from loomgraph.operators.search import vector_topk

U = np.uint64
#: Between candidates in a packed list.
END = "\x00"
#: Vectors that a task gathers before it sends them to their cells.
GATHER = 100_000


def freedom(x: np.ndarray) -> float:
    """The effective number of dimensions in which unit vectors spread: (sum of variances)^2 / sum of squared ones."""
    if len(x) < 2:
        return 1.0
    own = np.maximum(np.linalg.eigvalsh(np.cov(np.unique(x, axis=0).T.astype(np.float64))), 0) if len(np.unique(x, axis=0)) > 1 else np.ones(1)
    return max(1.0, float(own.sum() ** 2 / max((own**2).sum(), 1e-300)))


def open_cells(near: np.ndarray, rho: np.ndarray, bound: np.ndarray, d: float, z: float) -> np.ndarray:
    """(queries, cells): whether the stopping test leaves a cell open.

    near: the queries' cosine s with the cells' centres; rho: the members' cosine r with their centre; bound: the cosine to
    be beaten. A member's cosine with the query is s r plus sqrt(1 - s^2) sqrt(1 - r^2) u, u being the projection of one
    random direction on another, of variance 1/d. So d times the squared gap over (1 - s^2)(1 - r^2) is chi-square with one
    degree of freedom, and a cell is closed where that exceeds the quantile z^2.
    """
    gap = np.maximum(bound[:, None] - near * rho[None], 0)
    return gap * gap * d <= z * z * np.maximum((1 - near * near) * (1 - rho * rho)[None], 1e-9)


def centres_of(x: np.ndarray, k: int, sample: int = 20_000, rounds: int = 6) -> np.ndarray:
    """k unit centres of the vectors by spherical k-means on at most ``sample`` of them; the same on every run."""
    rng = np.random.default_rng(11)
    some = x[rng.choice(len(x), sample, replace=False)] if len(x) > sample else x
    centres = some[rng.choice(len(some), min(k, len(some)), replace=False)]
    for _ in range(rounds):
        cell = np.argmax(some @ centres.T, 1)
        order = np.argsort(cell, kind="stable")
        own, starts = np.unique(cell[order], return_index=True)
        centres[own] = np.add.reduceat(some[order], starts, axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Back:
    """The other direction: what a cell's vectors gain from the queries that visit it."""

    def __init__(self, kth: np.ndarray, top: int):
        self.best, self.at = np.repeat(kth[:, None], top, 1), np.full((len(kth), top), -1, np.int64)
        self.bound, self.first = kth, 0
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, begin: int, rows: np.ndarray, sims: np.ndarray) -> None:
        hit = np.flatnonzero(sims > self.bound[None, begin : begin + sims.shape[1]])
        if len(hit):
            row = hit // sims.shape[1]
            self.kept.append((hit - row * sims.shape[1] + begin, rows[row] + self.first, sims.ravel()[hit]))

    def settle(self) -> None:
        _keep_best(self.kept, self.best, self.at)
        self.kept.clear()
        self.bound = self.best[:, -1]


class Block:
    """Unit vectors of one part in cells around centres; rho: the cosine with its centre that most of a cell's members don't exceed."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.centres = centres_of(vectors, max(1, len(vectors) // leaf), rounds=4)
        cell = np.concatenate([np.argmax(vectors[s : s + 8192] @ self.centres.T, 1) for s in range(0, len(vectors), 8192)])
        self.order = np.argsort(cell, kind="stable")
        own, starts = np.unique(cell[self.order], return_index=True)
        self.centres = self.centres[own]
        self.ends = np.append(starts, len(vectors))
        self.vectors = np.ascontiguousarray(vectors[self.order])
        to = (self.vectors * np.repeat(self.centres, np.diff(self.ends), axis=0)).sum(1)
        self.rho = np.array([np.quantile(to[i:j], 0.95) for i, j in zip(self.ends, self.ends[1:])], np.float32)

    def packed(self, *besides) -> bytes:
        return pickle.dumps((self.vectors.astype(np.float16), self.centres, self.ends, self.rho, besides), 5)

    @staticmethod
    def unpacked(raw: bytes) -> tuple["Block", tuple]:
        self = Block.__new__(Block)
        vectors, self.centres, self.ends, self.rho, besides = pickle.loads(raw)
        self.vectors = vectors.astype(np.float32)
        return self, besides

    def search(self, q: np.ndarray, best: np.ndarray, at: np.ndarray, d: float, z: float, first: int = 2, back: Back | None = None) -> int:
        """Improves the k best similarities and places of each query, in place; gives the number of similarities computed.

        Queries without a bound visit their ``first`` nearest cells; then all visit the cells that the stopping test leaves open.
        """
        near = q @ self.centres.T
        done, cells = 0, near.shape[1]
        seen = np.zeros(near.shape, bool)
        new = np.flatnonzero(best[:, -1] <= -2)
        if len(new):
            edge = np.partition(near[new], cells - min(first, cells), axis=1)[:, cells - min(first, cells)]
            seen[new] = near[new] >= edge[:, None]
            done += self._visit(q, seen, best, at, back)
        return done + self._visit(q, open_cells(near, self.rho, best[:, -1], d, z) & ~seen, best, at, back)

    def _visit(self, q: np.ndarray, go: np.ndarray, best: np.ndarray, at: np.ndarray, back: Back | None) -> int:
        done, bound = 0, best[:, -1].copy()
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for cell in np.flatnonzero(go.any(0)):
            rows = np.flatnonzero(go[:, cell])
            begin, end = self.ends[cell], self.ends[cell + 1]
            sims = q[rows] @ self.vectors[begin:end].T
            done += sims.size
            if back:
                back.add(begin, rows, sims)
            hit = np.flatnonzero(sims > bound[rows][:, None])
            if not len(hit):
                continue
            row = hit // sims.shape[1]
            kept.append((rows[row], hit - row * sims.shape[1] + begin, sims.ravel()[hit]))
            if sum(len(k[0]) for k in kept) > 8 * len(q):
                # many are better: tighten the bounds before going on
                _keep_best(kept, best, at)
                kept.clear()
                bound = best[:, -1].copy()
        _keep_best(kept, best, at)
        return done


def _keep_best(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]], best: np.ndarray, at: np.ndarray) -> None:
    """Merges candidates (query, place, similarity) into each query's k best."""
    if not kept:
        return
    k = best.shape[1]
    row, place, sim = (np.concatenate(x) for x in zip(*kept))
    used = np.unique(row)
    row = np.concatenate([row, np.repeat(used, k)])
    place, sim = np.concatenate([place, at[used].ravel()]), np.concatenate([sim, best[used].ravel()])
    order = np.lexsort((-sim, row))
    row, place, sim = row[order], place[order], sim[order]
    first = np.searchsorted(row, used)
    take = first[:, None] + np.arange(k)
    best[used], at[used] = sim[take], place[take]


def signatures(x: np.ndarray) -> np.ndarray:
    """(n, 2) signed 128-bit names of single-precision vectors; equal vectors have equal names."""
    bits = x.view(np.uint32).astype(U) + (np.arange(1, x.shape[1] + 1, dtype=U) << U(32))
    return np.stack([J.mix(J.mix(bits ^ U(s)).sum(1)) for s in (0, 0x9E3779B97F4A7C15)], 1).view(np.int64)


def merged(keys: list[list], x: np.ndarray, top: int) -> tuple[list[list], np.ndarray]:
    """Equal vectors merged into one with its ``top`` smallest keys."""
    _, first, group = np.unique(np.ascontiguousarray(x).view(f"V{4 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    out: list[list] = [[] for _ in first]
    for g, ks in zip(group.tolist(), keys):
        out[g] += ks
    return [w if len(w) == 1 else sorted(set(w))[:top] for w in out], np.ascontiguousarray(x[first])


def _unit(lists: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable ones: of the right length, no null, NaN or infinite value, not all zero."""
    rows = np.array([i for i, v in enumerate(lists) if v is not None and len(v) == dim], np.int64)
    if not len(rows):
        return rows, np.zeros((0, dim))
    x = np.array([lists[i] for i in rows], np.float64)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[ok]
    x = x / np.abs(x).max(1, keepdims=True)
    return rows[ok], x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0  # no negative zeros


def exact_nearest(items: DataFrame, key: str, vector: str, asks: Column, k: int = 5, dim: int = 64) -> DataFrame:
    """The exact answers for the items that ``asks`` holds for, against all items, by blocks: key, neighbour_id, cosine (6
    places), rank. Ties at that precision go to the smaller key. For a bounded share of queries, as in measuring recall."""
    rows = items.select(F.col(key).alias("item_id"), F.col(vector).alias("v"), asks.alias("asks")).where(usable(F.col("v"), dim) & F.exists("v", lambda x: x != 0))
    found = vector_topk(rows.where("asks").select(F.col("item_id").alias("query_id"), "v"), rows.select("item_id", "v"), k)
    return found.select(F.col("query_id").alias(key), F.col("item_id").alias("neighbour_id"), F.col("vector_score").alias("cosine"), F.col("vector_rank").alias("rank"))


def usable(vector: Column, dim: int) -> Column:
    return (F.size(vector) == dim) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))


def nearest(
    items: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, cell: int = 8192, probes: int = 8, leaf: int = 64, inner: float = 4.5, outer: float = 5.0,
    sample_rows: int = 200_000, most_cells: int = 16_384, seed: int = 7, exact: bool = False,
) -> DataFrame:
    """The k other items of highest cosine for every item, on equal cosines those with the smaller key.

    1. About n / ``cell`` centres (at most ``most_cells``, beyond that cells grow) are fitted to at most ``sample_rows`` vectors.
       Every vector is stored once, in the cell of its nearest centre; copies of a vector are merged, keeping their k + 1
       smallest keys, so a group of copies is one vector wherever it is searched.
    2. A cell is indexed once, in leaves of about ``leaf`` vectors. It answers its own vectors, leaf by leaf, until the
       stopping test (``open_cells``, quantile ``inner``) holds. With the cosine of its k-th best as bound, a vector then goes
       to the other cells that the test leaves open at ``outer``, at most to the ``probes`` nearest, and is searched there
       in the same way, against the same index. What is compared there serves both sides: a pair is found when either goes
       to the other's cell.
    3. Only candidates better than the bound come back; they are merged per vector.
    What travels with a vector is bounded by ``probes``, what a task holds by the size of a cell. Vectors travel in half
    precision, so cosines from other cells are right to 0.0003. With ``exact`` no test is made and each vector goes to all
    cells: exact up to that rounding, with n^2 work.

    Defined cases: vectors that are null, of another length, hold a null, NaN or infinite value, or are all zero take no
    part, nor do rows whose key is null or holds U+0000; an item with fewer than k others has all of them; repeated rows count once; a key with several vectors takes
    part with each, and has the answer of one of them, the same on every run; an empty input gives an empty result. Result: key, neighbour_id, cosine.
    """
    spark: SparkSession = items.sparkSession
    rows = items.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v"))
    rows = rows.where(usable(F.col("v"), dim) & F.col("k").isNotNull() & ~F.contains("k", F.lit(END)))
    n = rows.count()
    parts, top = max(1, min(most_cells, math.ceil(n / cell))), k + 1
    if exact:
        inner, outer, probes = math.inf, math.inf, parts
    centres, rho, d = np.zeros((1, dim), np.float32), np.zeros(1, np.float32), 1.0
    if n:
        wanted = min(sample_rows, max(20_000, 32 * parts))
        picked = rows.select("v").sample(min(1.0, 1.2 * wanted / n), seed=seed).limit(wanted).toPandas()["v"]
        sample = _unit(list(picked), dim)[1].astype(np.float32)
        d = freedom(sample)
        if parts > 1 and len(sample):
            centres = centres_of(sample, parts, sample=wanted)
            near = sample @ centres.T
            home_of = near.argmax(1)
            rho = (np.bincount(home_of, near.max(1), len(centres)) / np.maximum(np.bincount(home_of, minlength=len(centres)), 1)).astype(np.float32)
    parts = len(centres)

    def cells_of(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[s : s + 8192] @ centres.T, 1) for s in range(0, len(x), 8192)])

    def sent(keys: list, x: np.ndarray) -> pd.DataFrame:
        names, x = merged([[w] for w in keys], x, top)
        part = cells_of(x)
        order = np.argsort(part, kind="stable")
        own, starts = np.unique(part[order], return_index=True)
        out = []
        for p, mine in zip(own.tolist(), np.split(order, starts[1:])):
            out.append((p, pickle.dumps(([names[i] for i in mine], x[mine]), 5)))
        return pd.DataFrame(out, columns=["part", "block"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held, size = [], [], 0
        for b in batches:
            at, x = _unit(list(b["v"]), dim)
            if len(at):
                keys += b["k"].to_numpy()[at].tolist()
                held.append(x.astype(np.float32))
                size += len(at)
            if size >= GATHER:
                yield sent(keys, np.concatenate(held))
                keys, held, size = [], [], 0
        if size:
            yield sent(keys, np.concatenate(held))

    def belong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, x = _unit(list(b["v"]), dim)
            s = signatures(x.astype(np.float32))
            yield pd.DataFrame({"k": b["k"].to_numpy()[at], "hi": s[:, 0], "lo": s[:, 1]})

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for b in batches:
            for p, raw in zip(b["part"], b["block"]):
                found.setdefault(int(p), []).append(pickle.loads(raw))
        for part in list(found):
            blocks = found.pop(part)
            keys, x = merged([w for ks, _ in blocks for w in ks], np.concatenate([v for _, v in blocks]), top)
            index = Block(x, leaf)
            smallest = [keys[g] for g in index.order]
            v, sig = index.vectors, signatures(index.vectors)
            best, at = np.full((len(v), top), -2.0, np.float32), np.zeros((len(v), top), np.int64)
            for s in range(0, len(v), 1024):
                e = slice(s, s + 1024)
                index.search(v[e], best[e], at[e], d, inner)
            own = packed(best, at, smallest)
            if parts == 1:
                yield rows_of(sig, own)
                continue
            out = [(part, 0, index.packed(smallest, sig, best[:, -1]))]
            target: dict[int, list[np.ndarray]] = {}
            for s in range(0, len(v), 1024):
                e = slice(s, s + 1024)
                out.append((part, 2, pickle.dumps((sig[e], own[e]), 5)))
                near = v[e] @ centres.T
                go = open_cells(near, rho, best[e, -1], d, outer)
                go[:, part] = False
                near[~go] = -9
                most = min(probes, parts)
                edge = np.partition(near, parts - most, axis=1)[:, parts - most]
                q, p = np.nonzero(go & (near >= edge[:, None]))
                order = np.argsort(p, kind="stable")
                to, starts = np.unique(p[order], return_index=True)
                for t, r in zip(to.tolist(), np.split(q[order] + s, starts[1:])):
                    target.setdefault(t, []).append(r)
            for t, r in target.items():
                r = np.concatenate(r)
                for i in np.split(r, range(2048, len(r), 2048)):
                    out.append((t, 1, pickle.dumps((sig[i], v[i].astype(np.float16), best[i, -1], [smallest[j] for j in i]), 5)))
            for s in range(0, len(out), 64):
                t, kind, piece = zip(*out[s : s + 64])
                yield pd.DataFrame({"task": t, "kind": kind, "block": piece, "hi": 0, "lo": 0, "found": None})

    def packed(best: np.ndarray, at: np.ndarray, smallest: list) -> list[str]:
        """Each vector's candidates in one string: the angle's place in six digits and the key, so that the best sorts first."""
        code = np.round((1 - np.minimum(best, 1.0).astype(np.float64)) * 1e6).astype(np.int64)
        return [END.join(f"{n:07d}{w}" for n, j, b in zip(cs, js, bs) if j >= 0 and b > -2 for w in smallest[j]) for cs, js, bs in zip(code.tolist(), at.tolist(), best.tolist())]

    def rows_of(sig: np.ndarray, found: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"task": -1, "kind": 3, "block": None, "hi": sig[:, 0], "lo": sig[:, 1], "found": found})

    def abroad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, index, back, mine, theirs = -1, None, None, None, []

        def gained() -> Iterator[pd.DataFrame]:
            if back:
                back.settle()
                hit = np.flatnonzero((back.at >= 0).any(1))
                if len(hit):
                    yield rows_of(mine[1][hit], packed(back.best[hit], back.at[hit], theirs))

        for b in batches:
            for p, kind, raw in zip(b["task"], b["kind"], b["block"]):
                if kind == 0:
                    yield from gained()
                    part, theirs = p, []
                    index, mine = Block.unpacked(raw)
                    back = Back(mine[2], top)
                elif kind == 2:
                    yield rows_of(*pickle.loads(raw))
                elif part == p:  # a cell without vectors has no index
                    sig, q, kth, names = pickle.loads(raw)
                    best, at = np.repeat(kth[:, None], top, 1), np.full((len(q), top), -1, np.int64)
                    back.first = len(theirs)
                    theirs += names
                    index.search(q.astype(np.float32), best, at, d, inner, back=back)
                    back.settle()
                    hit = np.flatnonzero((at >= 0).any(1))
                    if len(hit):
                        yield rows_of(sig[hit], packed(best[hit], at[hit], mine[0]))
        yield from gained()

    schema = "task int, kind int, block binary, hi long, lo long, found string"
    answers = rows.mapInPandas(send, "part int, block binary").repartitionById(parts, "part").mapInPandas(home, schema)
    if parts > 1:
        answers = answers.repartitionById(parts, "task").sortWithinPartitions("task", "kind").mapInPandas(abroad, schema)
    every = F.array_sort(F.split(F.concat_ws(END, F.collect_list("found")), END))
    name = lambda f: F.substr(f, F.lit(8))
    # a pair found from both sides counts once
    found = answers.groupBy("hi", "lo").agg(F.filter(every, lambda f: f != "").alias("found")).withColumn("names", F.transform("found", name))
    lists = found.select("hi", "lo", F.slice(F.filter("found", lambda f, i: F.array_position(F.col("names"), name(f)) == i + 1), 1, top).alias("found"))
    members = rows.mapInPandas(belong, "k string, hi long, lo long").groupBy("k").agg(F.min(F.struct("hi", "lo")).alias("c")).select("k", "c.hi", "c.lo")
    others = F.filter("found", lambda f: name(f) != F.col("k"))
    out = members.join(lists, ["hi", "lo"]).select("k", F.explode(F.slice(others, 1, k)).alias("f"))
    kind = items.schema[key].dataType
    return out.select(F.col("k").cast(kind).alias(key), F.substr("f", F.lit(8)).cast(kind).alias("neighbour_id"), (1 - F.substr("f", F.lit(1), F.lit(7)).cast("long") / 1e6).alias("cosine"))
