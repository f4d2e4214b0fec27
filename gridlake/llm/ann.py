"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables keys a vector by ``hashes`` values floor((a.x + b) / width) with Gaussian a.
A query ranks the buckets around its own by the estimated probability that a neighbour at the target
radius lies there (its distance to each slot's edges under the Gaussian), and visits them in this order
until the estimate over all tables reaches ``success``. Candidates of all tables are merged, and their
exact Euclidean distances in double precision rank them. A query that meets fewer candidates than it
should is searched exactly.

The target radius comes from a bounded sample (``sample`` rows, a parameter); every row is indexed.
Queries are taken in blocks of ``block`` vectors against all rows: no row of the base moves, each task
returns its nearest k for each query, and these partial results are merged.

Equal vectors hash alike and one bucket may hold many: they are candidates together, the nearest k of a
task are all that leaves it. Defined cases: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do vectors of another length than the most usual one; repeated
rows are candidates of their own, a row is never its own neighbour (rows are told apart by id);
ties go to the smaller id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

_phi = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))


@dataclass
class PStableHash:
    a: np.ndarray  # tables x hashes x dim
    b: np.ndarray
    width: float
    mix: np.ndarray

    @classmethod
    def make(cls, dim: int, radius: float, tables: int, hashes: int, seed: int = 7) -> PStableHash:
        rng = np.random.default_rng(seed)
        width = 1.6 * max(radius, 1e-9)
        return cls(rng.standard_normal((tables, hashes, dim)), rng.random((tables, hashes)) * width, width, rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1)

    def place(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t].T + self.b[t]) / self.width

    def keys(self, slots: np.ndarray) -> np.ndarray:
        return (slots.astype(np.int64) * self.mix).sum(-1)

    def probes(self, q: np.ndarray, t: int, radius: float, target: float) -> list[np.ndarray]:
        """For each query the bucket keys to visit, the likeliest first, until ``target`` is reached."""
        f = self.place(q, t)
        home = np.floor(f)
        edge, scale = (f - home), self.width / max(radius, 1e-12)
        p = np.stack([_phi((d + 1 - edge) * scale) - _phi((d - edge) * scale) for d in (-1, 0, 1)])  # step x query x hash
        sets = np.array(list(product((0, 1, 2), repeat=f.shape[1])))
        prob = np.ones((len(q), len(sets)))
        for h in range(f.shape[1]):
            prob *= p[sets[:, h], :, h].T
        order = np.argsort(-prob, axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(prob, order, 1), 1)
        out = []
        for i in range(len(q)):
            n = min(len(sets), int(np.searchsorted(reach[i], target)) + 1)
            out.append(self.keys(home[i] + sets[order[i, :n]] - 1))
        return out


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def _stack(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)


def best(ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, ties by id."""
    if dist.size > k:
        cut = np.partition(dist, k - 1)[k - 1]
        near = np.flatnonzero(dist <= cut)
    else:
        near = np.arange(dist.size)
    return near[np.lexsort((ids[near], dist[near]))][:k]


def search(base: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", tables: int = 8, hashes: int = 6, success: float = 0.97, sample: int = 2000, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found for each query, nearest first."""
    spark = base.sparkSession
    common.text_batches(spark, 4096)
    schema = "query_id long, vec_id long, score double"
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(F.col("i").isNotNull()).where(usable(F.col("v")))
    rows, asked = pick(base), pick(queries)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    none = spark.createDataFrame([], schema)
    if not sizes:
        return none.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    x = _stack(r["v"] for r in rows.orderBy(F.xxhash64("i"), "i").limit(sample).collect())
    radius = _radius(x, n, k)
    lsh = PStableHash.make(dim, radius, tables, hashes)
    blocks = max(1, -(-asked.count() // block))
    ended = None
    for at in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == at).distinct().collect()
        if not mine:
            continue
        q = _stack(r["v"] for r in mine)
        part = _visit(rows, np.array([r["i"] for r in mine], dtype=np.int64), q, lsh, radius, k, success, schema)
        ended = part if ended is None else ended.unionByName(part)
    if ended is None:
        return none.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return ended.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _radius(x: np.ndarray, n: int, k: int) -> float:
    """A distance within which most rows should have k neighbours among n: from the sample, on the safe side."""
    if len(x) < 2:
        return 1.0
    m = max(1, min(len(x) - 1, -(-k * len(x) // max(n, 1))))
    out = []
    for i in range(0, len(x), 256):
        y = x[i : i + 256]
        d = np.sqrt(np.maximum(0, (y**2).sum(1)[:, None] + (x**2).sum(1) - 2 * y @ x.T))
        d[np.arange(len(y)), np.arange(i, i + len(y))] = np.inf
        out.append(np.partition(d, m - 1, axis=1)[:, m - 1])
    return float(max(np.quantile(np.concatenate(out), 0.9), 1e-9))


def _visit(rows: DataFrame, ids: np.ndarray, q: np.ndarray, lsh: PStableHash, radius: float, k: int, success: float, schema: str) -> DataFrame:
    per_table = 1 - (1 - success) ** (1 / len(lsh.a))
    plan = []
    for t in range(len(lsh.a)):
        probes = lsh.probes(q, t, radius, per_table)
        key = np.concatenate(probes)
        owner = np.repeat(np.arange(len(q)), [p.size for p in probes])
        order = np.lexsort((owner, key))
        plan.append((key[order], owner[order]))
    shared = rows.sparkSession.sparkContext.broadcast((ids, q, lsh, plan))

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, lsh, plan = shared.value
        held: list[list[np.ndarray]] = [[np.empty(0, np.int64), np.empty(0)] for _ in ids]

        def add(to, i, c, d):
            c, d = np.concatenate((to[i][0], c)), np.concatenate((to[i][1], d))
            keep = best(c, d, k)
            to[i] = [c[keep], d[keep]]

        for p in parts:
            for s in range(0, len(p), 4096):
                x, own = _stack(p["v"].iloc[s : s + 4096]), p["i"].to_numpy(np.int64)[s : s + 4096]
                hit = np.zeros((len(ids), len(x)), dtype=bool)
                for t, (key, owner) in enumerate(plan):
                    mine = lsh.keys(np.floor(lsh.place(x, t)))
                    lo, hi = np.searchsorted(key, mine), np.searchsorted(key, mine, side="right")
                    n = hi - lo
                    if n.any():
                        row = np.repeat(np.arange(len(x)), n)
                        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                        hit[owner[at], row] = True
                hit &= ids[:, None] != own[None, :]
                for i in np.flatnonzero(hit.any(1)):
                    c = np.flatnonzero(hit[i])
                    diff = x[c] - q[i]
                    add(held, i, own[c], np.sqrt(np.einsum("ij,ij->i", diff, diff)))
        for i in range(len(ids)):
            if held[i][0].size:
                yield pd.DataFrame({"query_id": ids[i], "vec_id": held[i][0], "score": held[i][1]})

    return _complete(rows, rows.mapInPandas(near, schema), shared, k, schema)


def _complete(rows: DataFrame, found: DataFrame, shared, k: int, schema: str) -> DataFrame:
    """Queries that met fewer than k candidates in all are searched exactly: a second visit for them alone."""
    spark = rows.sparkSession
    found = common.cut(found)
    counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    ids, q, _, _ = shared.value
    short = np.array([i for i in range(len(ids)) if counts.get(int(ids[i]), 0) < k], dtype=np.int64)
    if not short.size:
        return found
    few = spark.sparkContext.broadcast((ids[short], q[short]))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = few.value
        held = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        for p in parts:
            for s in range(0, len(p), 4096):
                x, own = _stack(p["v"].iloc[s : s + 4096]), p["i"].to_numpy(np.int64)[s : s + 4096]
                for i in range(len(ids)):
                    c = np.flatnonzero(own != ids[i])
                    diff = x[c] - q[i]
                    a, d = np.concatenate((held[i][0], own[c])), np.concatenate((held[i][1], np.sqrt(np.einsum("ij,ij->i", diff, diff))))
                    keep = best(a, d, k)
                    held[i] = (a[keep], d[keep])
        for i in range(len(ids)):
            if held[i][0].size:
                yield pd.DataFrame({"query_id": ids[i], "vec_id": held[i][0], "score": held[i][1]})

    whole = found.where(~F.col("query_id").isin([int(i) for i in ids[short]]))
    return whole.unionByName(rows.mapInPandas(scan, schema))
