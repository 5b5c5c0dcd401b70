"""Gradient boosting on histograms, with missing values as a branch of their own.

Features are cut at up to 254 places between quantiles of the training rows. A
tree grows from sums of gradients, hessians and rows by (node, feature, bin),
which one aggregation gives for all open nodes at once; whatever the rows are,
the sums are at most 256 bins for each node and feature, and only they reach the
driver. Rows stay in blocks of codes with their scores, which a checkpoint
renews every ``RENEW`` trees. Up to ``ONE_TASK`` entries, all of this runs
within one task on the same sums.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.tables import settled

BINS, MISSING = 256, 255
#: Rows of a block; entries (rows times features) that one task takes; trees between two checkpoints of scores.
BLOCK, ONE_TASK, RENEW = 1 << 16, 1 << 23, 10
#: Fixed value: a child has at least this much hessian.
LEAST_HESSIAN = 1e-3


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1. Codes up to ``bin`` go left, missing ones where ``missing_left`` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.missing_left[node] = feature, at, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for values, new in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                values.append(new)
        return self.left[node], self.right[node]

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row of codes ends in."""
        node = np.zeros(len(codes), dtype=np.int64)
        for k, f in enumerate(self.feature):  # a node comes before its children
            if f >= 0:
                own = np.flatnonzero(node == k)
                c = codes[own, f]
                goes = np.where(c == MISSING, self.missing_left[k], c <= self.bin[k])
                node[own] = np.where(goes, self.left[k], self.right[k])
        return node

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(codes)]


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    depth: int = 3
    leaves: int = 15
    rate: float = 0.03
    least: int = 200
    l2: float = 1.0
    direction: bool = True


def encode(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Codes of rows of numbers: how many cuts lie below; ``MISSING`` for what isn't a number."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(c, x[:, j], side="left"))
    return out


def slopes(score: np.ndarray, y: np.ndarray, direction: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss, or of half the squared error."""
    if not direction:
        return score - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-score))
    return p - y, p * (1 - p)


def histograms(codes: np.ndarray, g: np.ndarray, h: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of gradient, hessian and rows by (open node, feature, bin); place is the row's open node, -1 for none."""
    own = np.flatnonzero(place >= 0)
    out = np.empty((n, codes.shape[1], BINS, 3))
    for j in range(codes.shape[1]):
        at = place[own] * BINS + codes[own, j]
        for k, w in enumerate((g[own], h[own], None)):
            out[:, j, :, k] = np.bincount(at, w, minlength=n * BINS).reshape(n, BINS)
    return out


def best_split(sums: np.ndarray, s: Settings) -> tuple[float, int, int, bool, np.ndarray] | None:
    """(gain, feature, bin, missing left, sums of the left child) of a node's best split; the first of equals. None if no split gains."""
    total = sums[0].sum(axis=0)
    inner = np.cumsum(sums[:, :MISSING], axis=1)[:, :-1]  # up to each bin, that of the last one left out
    lost = sums[:, MISSING][:, None, :]
    left = np.stack([inner, inner + lost], axis=1)  # missing values right, then left
    right = total - left
    value = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.l2)
    ok = (left[..., 2] >= s.least) & (right[..., 2] >= s.least) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
    ok[:, 1] &= lost[..., 2] > 0  # without missing values both sides are the same
    gain = np.where(ok, value(left) + value(right) - value(total), -np.inf)
    f, side, at = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, side, at] > 0:
        return None
    own = left[f, side, at]
    missing_left = bool(side) if lost[f, 0, 2] > 0 else bool(own[2] > total[2] - own[2])
    return float(gain[f, side, at]), int(f), int(at), missing_left, own


def grow(sums_of: Callable[[Tree, list[int]], np.ndarray], s: Settings) -> Tree:
    """A tree, best split first up to ``leaves`` leaves. Where the depth alone bounds the tree, the order doesn't matter and a level is summed at once."""
    tree, heap, leaves, depth = Tree(), [], 1, {0: 0}
    by_level = 2**s.depth <= s.leaves

    def put(nodes: list[int]) -> None:
        for node, sums in zip(nodes, sums_of(tree, nodes), strict=True):
            total = sums[0].sum(axis=0)
            tree.value[node] = -s.rate * total[0] / (total[1] + s.l2)
            if depth[node] < s.depth and (found := best_split(sums, s)):
                heapq.heappush(heap, (-found[0], node, found))

    put([0])
    while heap and leaves < s.leaves:
        new = []
        for _ in range(len(heap) if by_level else 1):
            if leaves < s.leaves:
                _, node, (_, f, at, missing_left, _) = heapq.heappop(heap)
                children = tree.split(node, f, at, missing_left)
                depth |= {c: depth[node] + 1 for c in children}
                new += children
                leaves += 1
        put(new)
    return tree


def _places(tree: Tree, codes: np.ndarray, nodes: list[int]) -> np.ndarray:
    of = np.full(len(tree.feature), -1)
    of[nodes] = np.arange(len(nodes))
    return of[tree.leaves(codes)]


def fit_arrays(codes: np.ndarray, y: np.ndarray, base: float, s: Settings) -> list[Tree]:
    """The trees of rows at hand."""
    score, out = np.full(len(y), base), []
    for _ in range(s.trees):
        g, h = slopes(score, y, s.direction)
        tree = grow(lambda t, nodes, g=g, h=h: histograms(codes, g, h, _places(t, codes, nodes), len(nodes)), s)
        score += tree.scores(codes)
        out.append(tree)
    return out


def fit_blocks(blocks: DataFrame, d: int, base: float, s: Settings) -> list[Tree]:
    """The trees of rows in blocks (codes, y): an aggregation for each set of open nodes."""
    state = settled(blocks.withColumn("score", F.lit(None).cast("binary")))
    out: list[Tree] = []
    since: list[Tree] = []

    def rows(pdf: pd.DataFrame, later: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for codes, y, score in zip(pdf["codes"], pdf["y"], pdf["score"], strict=True):
            codes, y = np.frombuffer(codes, dtype=np.uint8).reshape(-1, d), np.frombuffer(y)
            at = np.full(len(y), base) if score is None else np.frombuffer(score).copy()
            for t in later:
                at += t.scores(codes)
            yield codes, y, at

    def sums_of(tree: Tree, nodes: list[int]) -> np.ndarray:
        later = list(since)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(nodes), d, BINS, 3))
            for pdf in batches:
                for codes, y, at in rows(pdf, later):
                    total += histograms(codes, *slopes(at, y, s.direction), _places(tree, codes, nodes), len(nodes))
            flat = total.reshape(-1, 3)
            cell = np.flatnonzero(flat[:, 2])
            yield pd.DataFrame({"cell": cell, "g": flat[cell, 0], "h": flat[cell, 1], "n": flat[cell, 2]})

        flat = np.zeros((len(nodes) * d * BINS, 3))
        for r in state.mapInPandas(run, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
            flat[r[0]] = r[1:]
        return flat.reshape(len(nodes), d, BINS, 3)

    def renew(later: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(score=[at.tobytes() for _, _, at in rows(pdf, later)])

        return settled(state.mapInPandas(run, state.schema))

    for _ in range(s.trees):
        out.append(grow(sums_of, s))
        since.append(out[-1])
        if len(since) == RENEW:
            state, since = renew(list(since)), []
    return out


@dataclass
class Boosted:
    """A fitted model. Scores are probabilities for a direction, else values."""

    columns: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    direction: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        codes = encode(x, self.cuts)
        raw = self.base + sum((t.scores(codes) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-raw)) if self.direction else raw

    def transform(self, df: DataFrame) -> DataFrame:
        """df plus prediction; nulls, NaN and infinities of features are missing values."""

        @F.pandas_udf("double")
        def run(*x: pd.Series) -> pd.Series:
            return pd.Series(self.scores(np.column_stack(x).astype(float)))

        return df.withColumn("prediction", run(*[_number(c) for c in self.columns]))

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "cuts": self.cuts, "base": self.base, "direction": self.direction, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        told = json.loads(text)
        return Boosted(told["columns"], told["cuts"], told["base"], [Tree(**t) for t in told["trees"]], told["direction"])

    def save(self, path: str, spark: SparkSession) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> Boosted:
        return Boosted.from_json(spark.read.text(path, wholetext=True).first()[0])


def _number(c: str):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fit(train: DataFrame, columns: list[str], label: str, s: Settings, one_task: int = ONE_TASK) -> Boosted:
    """A model of the rows with a label; a feature that isn't a finite number is missing. Without rows there are no trees and the base is 0."""
    rows = train.select(*[_number(c).alias(f"x{j}") for j, c in enumerate(columns)], _number(label).alias("y")).filter("y is not null")
    at = F.array(*[F.lit(i / 255) for i in range(BINS)])
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), *[F.percentile_approx(f"x{j}", at, 10_000).alias(f"q{j}") for j in range(len(columns))]).first()
    levels = [np.unique(np.array(row[f"q{j}"] or [0.0], dtype=float)) for j in range(len(columns))]
    cuts = [((v[1:] + v[:-1]) / 2)[: MISSING - 1].tolist() for v in levels]
    n, mean = row["n"], row["m"]
    if not n:
        return Boosted(list(columns), cuts, 0.0, [], s.direction)
    if s.direction:
        mean = min(max(mean, 1e-12), 1 - 1e-12)
    base = float(np.log(mean / (1 - mean))) if s.direction else float(mean)

    def coded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return encode(pdf[[f"x{j}" for j in range(len(columns))]].to_numpy(dtype=float), cuts), pdf["y"].to_numpy(dtype=float)

    if n * len(columns) <= one_task:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [coded(pdf) for pdf in batches]
            trees = fit_arrays(np.concatenate([c for c, _ in parts]), np.concatenate([y for _, y in parts]), base, s)
            yield pd.DataFrame({"trees": [json.dumps([vars(t) for t in trees])]})

        trees = [Tree(**t) for t in json.loads(rows.repartition(1).mapInPandas(whole, "trees string").first()[0])]
    else:

        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for pdf in batches:
                held.append(coded(pdf))
                size += len(pdf)
                if size >= BLOCK:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

        def packed(held: list) -> pd.DataFrame:
            return pd.DataFrame({"codes": [np.concatenate([c for c, _ in held]).tobytes()], "y": [np.concatenate([y for _, y in held]).tobytes()]})

        trees = fit_blocks(rows.mapInPandas(block, "codes binary, y binary"), len(columns), base, s)
    return Boosted(list(columns), cuts, base, trees, s.direction)
