"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled documents and
flattened into node arrays, so scoring a batch takes a few array operations a
level. On chosen statistics the score may only fall as the statistic grows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import short_batches, text_of
from panelspark.llm.labels import labelled_sample

#: Labelled documents that the trees are fitted on, at most.
MAX_TRAINING = 20_000
THRESHOLD = 0.5

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3

STOP = frozenset(b"the of and to in a is that for on it with as was be by are or de la le les et un une que qui dans en des du el los las y se del der die das und ist von zu den nicht mit im ein eine".split())
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and +1, -1 or 0: whether the score may only rise or only fall with one.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": 0,
    "digit_share": 0,
    "stop_share": 0,
    "exclamations_per_word": -1,
    "words_per_line": 0,
    "punctuation_share": 0,
    "lines_with_stop": 0,
    "non_ascii_share": 0,
}


def _without(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def repeated_words(words: list) -> int:
    """Words that lie in some window of ``WINDOW`` words which the text has twice or more."""
    windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + WINDOW - max(end, i)
            end = i + WINDOW
    return covered


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    seen: set[str] = set()
    dup = lines = ended = 0
    for line in text.split("\n"):
        bare = line.strip(" \t\x0b\x0c\r")
        if bare:
            lines += 1
            ended += bare[-1] in ".!?:;\"'"
            dup += line in seen
            seen.add(line)
    word_chars = len(text) - _without(raw, SPACE)
    symbols, repeats = _without(raw, SYMBOLS), repeated_words(words)
    counts = [n, word_chars, symbols, dup, repeats]
    if not n:
        return counts, [0.0] * len(FEATURES)
    letters = max(1, len(raw))
    upper, digits = _without(raw, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _without(raw, b"0123456789")
    stop = sum(w in STOP for w in words)
    features = [
        np.log1p(n),
        word_chars / n,
        symbols / n,
        dup / max(1, lines),
        repeats / n,
        len(set(words)) / n,
        upper / letters,
        digits / letters,
        stop / n,
        _without(raw, b"!") / n,
        n / max(1, lines),
        _without(raw, b".,;:?") / n,
        ended / max(1, lines),
        (len(raw) - len(text)) / letters,
    ]
    return counts, features


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: int = 5) -> Trees:
    """Boosted logistic loss on binned features; second-order gains; monotonic constraints by value bounds."""
    rate_1 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    node = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def leaf(value: float) -> int:
        me = len(node["value"])
        for k, v in zip(node, (0, np.inf, me, me, value), strict=True):
            node[k].append(v)
        return me

    if not len(y) or y.min() == y.max():  # nothing to tell apart
        return Trees(np.array([leaf(0.0)]), *(np.array(node[k]) for k in node), depth=0, base=base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    score = np.full(len(y), base)

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float, step: np.ndarray) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        own = weight(gs, hs, low, high)
        best = None
        if level < depth and len(rows) >= 2 * least:
            gain_of = lambda gg, hh, w: -(gg * w + 0.5 * (hh + l2) * w * w)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[j, rows]
                n = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                gl, hl = np.bincount(b, g[rows], len(c) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(c) + 1).cumsum()[:-1]
                wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                gain = gain_of(gl, hl, wl) + gain_of(gs - gl, hs - hl, wr) - gain_of(gs, hs, own)
                gain[(n < least) | (len(rows) - n < least)] = -np.inf
                if signs[j]:
                    gain[signs[j] * (wr - wl) < 0] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, float(wl[k]), float(wr[k]))
        me = leaf(rate * own)
        if best is None:
            step[rows] = rate * own
            return me
        _, j, k, wl, wr = best
        mid = (wl + wr) / 2
        to_left = binned[j, rows] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[j]]
        node["feature"][me], node["threshold"][me] = j, cuts[j][k]
        node["left"][me] = grow(rows[to_left], g, h, level + 1, *bounds[0], step)
        node["right"][me] = grow(rows[~to_left], g, h, level + 1, *bounds[1], step)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf, step))
        score += step
    return Trees(np.array(roots), *(np.array(node[k]) for k in node), depth=depth, base=base)


VERDICT = "struct<" + ",".join(f"{c}:bigint" for c in BASE) + ",score:double>"


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, target: str = "quality") -> Trees:
    """Trees fitted on at most ``most`` labelled documents. Without labels of both kinds the score is their mean."""

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t)[1] for t in texts])

    short_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, target, most).select(features(text_of()).alias("x"), "y").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(dtype=float), list(FEATURES.values()))


def _judged(docs: DataFrame, model: Trees, threshold: float) -> DataFrame:
    """docs plus _v (counts and score), _failed and _kept."""

    @F.pandas_udf(VERDICT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        found = [statistics(t) for t in texts]
        out = pd.DataFrame([c for c, _ in found], columns=list(BASE), dtype="int64")
        out["score"] = model.probability(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
        return out

    short_batches(docs.sparkSession)
    df = docs.withColumn("_v", verdict(text_of()))
    failed = (F.col("_v.n_words") < MIN_WORDS) | (100 * F.col("_v.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("_v.n_words"))
    return df.withColumn("_failed", failed).withColumn("_kept", ~F.col("_failed") & (F.col("_v.score") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, score): a row for each row of docs, repeated ones too.

    docs has doc_id and text, labels doc_id and quality; other columns are
    ignored. A null text counts as empty: all counts 0, not kept. A null doc_id
    stays null. An empty table gives an empty result.
    """
    model = train(docs, labels, most)
    df = _judged(docs.select("doc_id", "text"), model, threshold)
    return df.select("doc_id", *[F.col(f"_v.{c}").alias(c) for c in BASE], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_v.score").alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAINING) -> DataFrame:
    """The rows of docs that are kept, with the same columns; repeated rows fare alike.

    A null text counts as empty and fails; a null doc_id is judged by its text.
    An empty table gives an empty one.
    """
    return _judged(docs, train(docs, labels, most), threshold).filter("_kept").select(*docs.columns)
