"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Unit vectors are projected to a few dimensions by a Gaussian matrix. The square
of a projected distance over the square of the true one follows a chi-square
law, whatever the vectors. So a search looks at projected neighbours in order
of their distance and verifies them on the true vectors; it may stop once the
next projected distance is so large, against the k-th best true distance found,
that a closer vector would have shown up before with probability ``sure``.

The projected points are dealt out by a kd-tree whose planes are fitted on a
bounded sample; every vector is indexed. A query searches in rounds: its own
cell, then the few nearest ones, then all others that the test does not rule
out; each round starts from the k-th distance found so far. Cells are small,
and ``SHARD`` neighbouring ones, a subtree, make a shard: a round ships a query
once to each shard with a cell that it visits, and there the points of all
these cells are taken in projected order together. A shard's points are
shipped once for each ``QUERIES`` visits of it. Shards that outgrow their share
are split by a hash of the key, so that a task holds a bounded block of points
and of queries.

Equal vectors are one point, with the smallest of their ids: more of them than
a result has places can never be in one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import broadcast_if, saved

PROJECTED = 48
SURE = 0.9
#: Points that the trees' planes are fitted on, at most; those for each cell, at least; points in a cell, about.
MAX_SAMPLE, SAMPLED, CELL = 131_072, 16, 128
#: Cells of a shard; queries that visit a shard in one task, about; cells in the second round.
SHARD, QUERIES, NEAR = 32, 4_096, 8
#: Queries searched as one block; projected neighbours up to which each step verifies.
BLOCK, STEPS = 128, (8, 16, 32, 64, 128, 256, 512, 1_024, 2_048)
MAX_BROADCAST_SHARDS = 20_000
SEED = 23


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square law with an even number m of degrees of freedom."""
    low, high = 0.0, 1_000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if below < p else (low, x)
    return low


@cache
def projection(dim: int, m: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m))


@dataclass
class Tree:
    """Split planes in heap order (node i has children 2i+1 and 2i+2) and the boxes of the last level, its cells."""

    axis: np.ndarray
    at: np.ndarray
    depth: int
    low: np.ndarray
    high: np.ndarray

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (2**self.depth - 1)

    def squares(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        out = np.zeros((len(p), len(self.low)))
        for j in range(p.shape[1]):
            x = p[:, j : j + 1]
            out += np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0) ** 2
        return out


def build(sample: np.ndarray, n: int, cell: int = CELL) -> Tree:
    """Median splits along the widest axis until about ``cell`` of n points fall in a cell, or too little of the sample does."""
    m = sample.shape[1]
    depth = min(max(0, math.ceil(math.log2(max(1, n) / cell))), int(math.log2(max(1, len(sample) // SAMPLED))))
    axis, at = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    low, high = np.full((2 ** (depth + 1) - 1, m), -math.inf), np.full((2 ** (depth + 1) - 1, m), math.inf)
    parts = {0: sample}
    for node in range(len(axis)):
        own, left, right = parts.pop(node), 2 * node + 1, 2 * node + 2
        j = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
        axis[node], at[node] = j, np.median(own[:, j]) if len(own) else 0.0
        low[[left, right]], high[[left, right]] = low[node], high[node]
        high[left, j] = low[right, j] = at[node]
        beyond = own[:, j] > at[node]
        parts[left], parts[right] = own[~beyond], own[beyond]
    return Tree(axis, at, depth, low[len(axis) :], high[len(axis) :])


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(-1, dim)


def _scaled(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(vectors over a power of two each, their norms): no component or norm overflows, and the cosine is the same."""
    v = _matrix(rows, len(rows.iloc[0]) // 8)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def _projected(rows: pd.Series, m: int) -> np.ndarray:
    v, norms = _scaled(rows)
    return (v / norms[:, None]) @ projection(v.shape[1], m)


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The place of each element among the equal ones before it; equal ones stand together."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, dtype=np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


@dataclass
class Points:
    """Vectors, norms, projections and smallest ids of the points that a task holds."""

    v: np.ndarray
    norms: np.ndarray
    p: np.ndarray
    first: np.ndarray

    def search(self, q: np.ndarray, q_norms: np.ndarray, qp: np.ndarray, bound: np.ndarray, visited: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, point, score) of the k best points verified for each query, of those visited, and how many were verified.

        Projected neighbours are verified in order, a step of them at a time for
        the whole block of queries, until the next one fails the test.
        """
        gap = np.maximum((qp**2).sum(axis=1)[:, None] + (self.p**2).sum(axis=1) - 2 * qp @ self.p.T, 0)
        square = bound + 1e-9
        qi, pi = np.nonzero(visited & (gap <= limit * square[:, None]))
        order = np.lexsort((gap[qi, pi], qi))
        qi, pi = qi[order], pi[order]
        near, rank = gap[qi, pi], _ranks(qi)
        own_q, own_p, own_s, verified = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), 0
        worst = np.full(len(q), -2.0)
        for a, b in zip((0, *STEPS), (*STEPS, len(self.v)), strict=True):
            now = (rank >= a) & (rank < b) & (near <= limit * square[qi])
            x, y = qi[now], pi[now]
            if not len(x):
                continue
            verified += len(x)
            cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
            rough = np.concatenate([self.v[y[i:j]] @ q[x[i]] for i, j in zip(cuts, cuts[1:], strict=False)]) / (self.norms[y] * q_norms[x])
            good = rough >= worst[x] - 1e-9
            x, y = x[good], y[good]
            exact = np.einsum("ij,ij->i", self.v[y], q[x]) / (self.norms[y] * q_norms[x])
            own_q, own_p, own_s = np.r_[own_q, x], np.r_[own_p, y], np.r_[own_s, exact]
            best = np.lexsort((self.first[own_p], -own_s, own_q))
            place = _ranks(own_q[best])
            best, place = best[place < k], place[place < k]
            own_q, own_p, own_s = own_q[best], own_p[best], own_s[best]
            last = place == k - 1
            worst[own_q[last]] = own_s[last]
            square[own_q[last]] = np.minimum(square[own_q[last]], np.maximum(2 - 2 * own_s[last], 0) + 1e-9)
        return own_q, own_p, own_s, verified


def _frame(columns: dict) -> pd.DataFrame:
    """Columns of objects, so that empty ones convert to arrays as well."""
    return pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in columns.items()})


HITS = "hits array<struct<vec_id:bigint,score:double>>"


def best_of(hits: Column, k: int) -> Column:
    """The first k of an array of hits by score, then id."""
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    return F.slice(F.array_sort(hits, order), 1, k)


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """(key, v, ids, asked): one row for each distinct vector, with the ``keep`` smallest of its ids."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict[bytes, list] = {}
            for i, x, a in zip(pdf["vec_id"], pdf["v"], pdf["asked"], strict=True):
                own = held.setdefault((np.asarray(x, dtype=np.float64) + 0.0).tobytes(), [set(), False])
                own[1] |= a
                own[0].add(i)
                if len(own[0]) > keep:
                    own[0].remove(max(own[0]))
            yield _frame({"key": map(key_of, held), "v": held, "ids": [sorted(o[0]) for o in held.values()], "asked": [o[1] for o in held.values()]})

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    partial = rows.mapInPandas(distinct, "key binary, v binary, ids array<long>, asked boolean")
    return partial.groupBy("key").agg(F.first("v").alias("v"), smallest.alias("ids"), F.max("asked").alias("asked"))


def key_of(raw: bytes) -> bytes:
    return hashlib.sha1(raw).digest()


def nearest(vectors: DataFrame, asked: Column, k: int = 5, vector: str = "embedding", sure: float = SURE, m: int = PROJECTED, cell: int = CELL, told: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``asked`` picks.

    vectors has vec_id and the array column ``vector``; other columns are
    ignored. Nearness is cosine, computed in double precision on the original
    vectors (any finite size), ties to the smaller vec_id; a query is no
    candidate for itself. Rows take no part where vec_id is null or the vector
    is null, empty, zero, or holds null or non-finite numbers. Vectors of
    different lengths have no cosine; those of each length search one another.
    Ids that are repeated with one vector count once. Fewer candidates than k
    give fewer rows, an empty table none. Each length of vectors has a tree of
    its own in the driver, so lengths should be few. ``told`` gets the counts "points",
    "queries" and "verified" (pairs whose true distance was computed).
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    keep, limit = k + 1, chi_square_quantile(sure, m)
    reps = saved(distinct_points(rows, keep), "ann-distinct")
    spark = reps.sparkSession
    width = (F.length("v") / 8).cast("int")
    lengths = {r["d"]: r["n"] for r in reps.groupBy(width.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()}
    share = min(1_000_000, math.ceil(1_000_000 * MAX_SAMPLE / max(1, sum(lengths.values()))))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, own in pdf.groupby(pdf["v"].str.len() // 8):
                yield _frame({"d": [d] * len(own), "p": _projected(own["v"], m)})

    some = reps.filter(F.crc32("key") % 1_000_000 < share).mapInPandas(project, "d int, p array<double>").toPandas()
    trees = {d: build(np.array(some["p"][some["d"] == d].tolist(), dtype=float).reshape(-1, m), n, cell) for d, n in lengths.items()}
    # A shard has cells of one length only.
    first_cell = dict(zip(trees, np.cumsum([0, *(-(-(2**t.depth) // SHARD) * SHARD for t in trees.values())]).tolist(), strict=False))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, own in pdf.groupby(pdf["v"].str.len() // 8):
                p = _projected(own["v"], m)
                yield own.assign(p=[x.tobytes() for x in p], cell=first_cell[d] + trees[d].cell(p))

    placed = saved(reps.mapInPandas(place, "key binary, v binary, ids array<long>, asked boolean, p binary, cell long"), "ann-cells")
    # A shard that the bounded sample left too large is dealt out by a hash; its visitors visit all parts.
    shard_of = lambda c: F.floor(c / SHARD)
    parts = saved(placed.groupBy(shard_of(F.col("cell")).alias("shard")).agg(F.ceil(F.count(F.lit(1)) / (2 * cell * SHARD)).cast("int").alias("parts")), "ann-parts")
    n_shards = parts.count()
    few = lambda df: broadcast_if(df, n_shards, MAX_BROADCAST_SHARDS)
    points = placed.withColumn("shard", shard_of(F.col("cell"))).join(few(parts), "shard").withColumn("part", (F.crc32("key") % F.col("parts")).cast("int")).drop("parts")
    verified = spark.sparkContext.accumulator(0)

    def search(queries: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(pdf):
            return _frame({"key": [], "hits": []})
        held = Points(*_scaled(pdf["v"]), _matrix(pdf["p"], m), np.array([i[0] for i in pdf["ids"]], dtype=np.int64))
        (v, norms), p, bound = _scaled(queries["v"]), _matrix(queries["p"], m), queries["bound"].to_numpy(dtype=float)
        cells, of = np.unique(pdf["cell"].to_numpy(), return_inverse=True)
        own_q, own_p, own_s = [], [], []
        for at in range(0, len(queries), BLOCK):
            q = slice(at, at + BLOCK)
            visited = np.array([np.isin(cells, c) for c in queries["cells"].iloc[q]])
            qi, pi, s, seen = held.search(v[q], norms[q], p[q], bound[q], visited[:, of], keep, limit)
            verified.add(seen)
            own_q, own_p, own_s = own_q + (qi + at).tolist(), own_p + pi.tolist(), own_s + s.tolist()
        hits: dict[int, list] = {}
        ids = list(pdf["ids"])
        for a, b, c in zip(own_q, own_p, own_s, strict=True):
            hits.setdefault(a, []).extend({"vec_id": int(i), "score": c} for i in ids[b])
        return _frame({"key": [queries["key"].iloc[a] for a in hits], "hits": hits.values()})

    def visit(queries: DataFrame, name: str) -> DataFrame:
        """(key, hits) of the queries (key, v, p, bound, cells) in their cells, a row for each part of a shard with any."""
        go = queries.withColumn("shard", F.explode(F.array_distinct(F.transform("cells", shard_of))))
        go = go.withColumn("cells", F.filter("cells", lambda c: shard_of(c) == F.col("shard")))
        load = saved(go.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks")), f"ann-{name}-load")
        go = go.join(few(load), "shard").join(few(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        go = go.withColumn("chunk", (F.crc32("key") % F.col("chunks")).cast("int")).drop("parts", "chunks")
        target = points.drop("key", "asked").join(few(load), "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        by, n = ["shard", "part", "chunk"], int(spark.conf.get("spark.sql.shuffle.partitions"))
        return go.repartition(n, *by).groupBy(*by).cogroup(target.repartition(n, *by).groupBy(*by)).applyInPandas(search, f"key binary, {HITS}")

    def after(queries: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """queries with the hits so far and the squared distance that the last of them sets."""
        new = found.groupBy("key").agg(best_of(F.flatten(F.collect_list("hits")), keep).alias("new"))
        hits = best_of(F.concat("hits", F.coalesce("new", F.array().cast("array<struct<vec_id:bigint,score:double>>"))), keep)
        both = queries.join(new, "key", "left").withColumn("hits", hits).drop("new")
        kth = F.greatest(2 - 2 * F.get(F.col("hits"), F.lit(keep - 1))["score"], F.lit(0.0))
        return saved(both.withColumn("bound", F.coalesce(kth, F.lit(math.inf))), f"ann-{name}")

    def open_cells(queries: DataFrame, some: slice, seen: int) -> DataFrame:
        """queries with ``cells``: of those that the test doesn't rule out, nearest first, a slice; ``seen`` were visited before."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for d, own in pdf.groupby(pdf["v"].str.len() // 8):
                    cells = []
                    for at in range(0, len(own), BLOCK):
                        part = own.iloc[at : at + BLOCK]
                        gap = trees[d].squares(_matrix(part["p"], m))
                        home = part["cell"].to_numpy() - first_cell[d]
                        gap[np.arange(len(part)), home] = -1.0
                        order = np.argsort(gap, axis=1, kind="stable")[:, some]
                        fits = np.take_along_axis(gap, order, axis=1) <= limit * (part["bound"].to_numpy(dtype=float)[:, None] + 1e-9)
                        cells += [first_cell[d] + o[f] for o, f in zip(order, fits, strict=True)]
                    yield own[["key", "v", "p", "bound"]].assign(cells=pd.Series(cells, dtype=object, index=own.index))

        return saved(queries.select("key", "v", "p", "bound", "cell").mapInPandas(run, "key binary, v binary, p binary, bound double, cells array<long>"), f"ann-visits{seen}")

    queries = placed.filter("asked").select("key", "v", "p", "cell", F.lit(math.inf).alias("bound"), F.array().cast("array<struct<vec_id:bigint,score:double>>").alias("hits"))
    for no, (a, b) in enumerate(((0, 1), (1, 1 + NEAR), (1 + NEAR, None))):
        queries = after(queries, visit(open_cells(queries, slice(a, b), a), f"round{no}"), f"found{no}")
    if told is not None:
        told |= {"points": sum(lengths.values()), "queries": queries.count(), "verified": verified.value}

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["vec_id"], "key": [key_of((np.asarray(x, dtype=np.float64) + 0.0).tobytes()) for x in pdf["v"]]})

    named = rows.filter("asked").mapInPandas(keys, "query_id long, key binary").distinct()
    own = named.join(queries.select("key", "hits"), "key").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    out = own.select("query_id", F.posexplode("hits").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
