"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
(character classes, word shapes, repetition, hashed words), a learned layer
maps the encoding to a short vector, gated attention weighs the passages, and
the weighted vector is scored. Labels belong to documents; which passages
matter is learned from them.

Texts are encoded a batch at a time in numpy: all bytes of the batch are one
array, words and passages are ranges in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, remainder, saved, short_batches, text_of
from panelspark.llm.labels import labelled_sample

PASSAGE = 64
#: Labelled documents to learn from, and passages of all of them, at most: beyond that, whole documents are left out.
MAX_TRAINING = 8_000
MAX_PASSAGES = 1_000_000
HASHED = 24
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY, SEED = 160, 0.02, 1e-4, 5
#: Rows whose remainder of crc32(doc_id) by this is 1 are held out.
FOLDS = 3

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?'\"()-", b"!", b"#*$%&|<>~^_=+{}[]\\/@`"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _no, _chars in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_chars, dtype=np.uint8)] = _no
_CLASS[128:] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
_SPACE = np.zeros(256, dtype=bool)
_SPACE[np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)] = True
_POWERS = np.cumprod(np.full(4096, 1_099_511_628_211, dtype=np.uint64))
N_FEATURES = N_CLASSES + 8 + HASHED
#: Bytes that are encoded together, about.
PIECE = 1 << 20


@dataclass
class Earlier:
    """What a piece of a long text has to know of the whole: its words, and the hashes of those before the piece."""

    n_words: int
    seen: np.ndarray


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, the text each belongs to). A text without words has one passage of zeros."""
    return _encode([t.encode() for t in texts])


def _word_starts(raw: bytes) -> np.ndarray:
    space = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
    return np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)) == -1)


def encode_long(text: str) -> np.ndarray:
    """The features of one text's passages, the same as :func:`encode`'s, computed in pieces of whole passages."""
    raw = text.encode()
    cuts, at = [0], 0
    earlier = Earlier(0, np.zeros(0, dtype=np.uint64))
    while at + PIECE < len(raw):
        # A piece grows until it holds whole passages, and the next one begins with a word.
        size = PIECE
        while True:
            starts = _word_starts(raw[at : at + size])
            whole = (len(starts) - 1) // PASSAGE * PASSAGE if len(starts) else 0
            if whole > 0 or at + size >= len(raw):
                break
            size *= 2
        if whole <= 0:
            break
        earlier.n_words += whole
        at += int(starts[whole])
        cuts.append(at)
    earlier.n_words += len(_word_starts(raw[at:]))
    parts = [_encode([raw[a:b]], earlier, last=b == len(raw))[0] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
    return np.concatenate(parts)


def _encode(raws: list[bytes], earlier: Earlier | None = None, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The features of texts; or of one piece of a text, which ``earlier`` tells of and is told of."""
    texts = raws
    raw = np.frombuffer(b"\n".join(raws) + b"\n" * last, dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    space = _SPACE[raw]
    flips = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    first, after = flips[0::2], flips[1::2]  # a text never ends inside a word, as a line feed follows, and nor does a piece
    n_words = len(first)
    doc = np.searchsorted(ends, first, side="right")
    per_doc = np.bincount(doc, minlength=len(texts))
    in_doc = np.arange(n_words) - np.concatenate(([0], np.cumsum(per_doc)[:-1]))[doc]
    n_passages = np.maximum(1, -(-per_doc // PASSAGE))
    offset = np.concatenate(([0], np.cumsum(n_passages)))
    owner = np.repeat(np.arange(len(texts)), n_passages)
    out = np.zeros((offset[-1], N_FEATURES), dtype=np.float32)
    if not n_words:
        return out, owner
    passage = offset[doc] + in_doc // PASSAGE
    words = np.bincount(passage, minlength=len(out)).astype(float)
    full = np.maximum(words, 1)
    # Bytes from a word's start to the next one's belong to its passage.
    span = np.diff(np.append(first, len(raw)))
    of_byte = np.repeat(passage, span)
    classes = np.bincount(of_byte * N_CLASSES + _CLASS[raw[first[0] :]], minlength=len(out) * N_CLASSES).reshape(-1, N_CLASSES)
    out[:, :N_CLASSES] = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
    length = after - first
    at = np.arange(len(raw) - first[0]) - np.repeat(first - first[0], span)
    inside = at < np.repeat(length, span)
    terms = np.where(inside, (raw[first[0] :] | 0x20).astype(np.uint64) * _POWERS[at % len(_POWERS)], np.uint64(0))
    hashed = np.add.reduceat(terms, first - first[0])
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0x9E3779B97F4A7C15)
    k = N_CLASSES
    out[:, k] = np.bincount(passage, length, len(out)) / full / 10
    out[:, k + 1] = np.bincount(passage, length <= 3, len(out)) / full
    initial = raw[first]
    out[:, k + 2] = np.bincount(passage, (initial >= 65) & (initial <= 90), len(out)) / full
    order = np.lexsort((passage, hashed, doc))
    same_doc = np.zeros(n_words, dtype=bool)  # a word that the document had before
    a, b = order[1:], order[:-1]
    same_doc[a] = (doc[a] == doc[b]) & (hashed[a] == hashed[b])
    same_passage = np.zeros(n_words, dtype=bool)
    same_passage[a] = same_doc[a] & (passage[a] == passage[b])
    if earlier is not None:
        near = np.minimum(np.searchsorted(earlier.seen, hashed), max(0, len(earlier.seen) - 1))
        same_doc |= earlier.seen[near] == hashed if len(earlier.seen) else False
        earlier.seen = np.union1d(earlier.seen, hashed)
    out[:, k + 3] = np.bincount(passage, same_passage, len(out)) / full
    out[:, k + 4] = np.bincount(passage, same_doc, len(out)) / full
    out[:, k + 5] = np.bincount(passage, length > 14, len(out)) / full
    out[:, k + 6] = (np.log1p(per_doc)[owner] if earlier is None else np.log1p(earlier.n_words)) / 8
    out[:, k + 7] = words / PASSAGE
    slot = (hashed >> np.uint64(40)) % np.uint64(HASHED)
    sign = np.where((hashed >> np.uint64(39)) & np.uint64(1), 1.0, -1.0)
    out[:, k + 8 :] = np.bincount(passage * HASHED + slot.astype(np.int64), sign, len(out) * HASHED).reshape(-1, HASHED) / np.sqrt(full)[:, None]
    return out, owner


def slices(texts: list[str], chars: int = PIECE) -> list[list[str]]:
    """The texts in order, in groups of about so many characters; a longer text is a group of its own."""
    out: list[list[str]] = []
    room = 0
    for t in texts:
        if room < len(t) or not out:
            out.append([])
            room = chars
        out[-1].append(t)
        room -= len(t)
    return out


def encoded(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`encode` of a group of :func:`slices`, in bounded memory where it is one long text."""
    if len(group) > 1 or len(group[0]) <= PIECE:
        return encode(group)
    x = encode_long(group[0])
    return x, np.zeros(len(x), dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float | None = None

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """All layers; owner ascends and names each of the n bags."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"] + p["bv"]), _sigmoid(h @ p["u"] + p["bu"])
        gate = t * s
        e = gate @ p["a"]
        starts = np.searchsorted(owner, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        weight = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "gate": gate, "weight": weight, "z": z, "starts": starts, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        parts = [self.forward(self.standard(x), owner, owner[-1] + 1)["score"] for x, owner in map(encoded, slices(texts))]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam on the logistic loss of the bags, all of them at a time. One kind of label, or none, gives their mean."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, prior=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    shapes = {"w": (N_FEATURES, HIDDEN), "b": HIDDEN, "v": (HIDDEN, GATE), "bv": GATE, "u": (HIDDEN, GATE), "bu": GATE, "a": GATE, "c": HIDDEN, "d": ()}
    p = {k: (rng.normal(0, 0.3 / np.sqrt(s[0]) * 2, s) if isinstance(s, tuple) and s else rng.normal(0, 0.3, s) if k in "ac" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    model = Model(mean, scale, p)
    x = model.standard(x)
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    for step in range(1, epochs + 1):
        f = model.forward(x, owner, len(y))
        dl = ((f["score"] - y) / len(y)).astype(np.float32)
        dz = dl[:, None] * p["c"]
        dh = f["weight"][:, None] * dz[owner]
        dw = (f["h"] * dz[owner]).sum(axis=1)
        de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, f["starts"])[owner])
        dg = de[:, None] * p["a"]
        dv, du = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (dh + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        g = {"w": x.T @ dh, "b": dh.sum(0), "v": f["h"].T @ dv, "bv": dv.sum(0), "u": f["h"].T @ du, "bu": du.sum(0), "a": f["gate"].T @ de, "c": f["z"].T @ dl, "d": dl.sum()}
        for k in p:
            grad = g[k] + DECAY * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, passages: int = MAX_PASSAGES, target: str = "quality") -> Model:
    """A model from at most ``most`` labelled documents that are not held out, with all their passages.

    Where those are more than ``passages``, documents are left out as a whole,
    the longest ones first.
    """

    @F.pandas_udf("array<float>")
    def bags(texts: pd.Series) -> pd.Series:
        own = []
        for group in slices(list(texts)):
            x, owner = encoded(group)
            own += np.split(x, np.searchsorted(owner, np.arange(1, len(group))))
        return pd.Series([b.ravel() for b in own])

    short_batches(docs.sparkSession)
    some = saved(labelled_sample(docs, labels, target, most, where=remainder("doc_id", FOLDS) != 1), "mil-sample")
    # Not more rows than ``most``, so one task can order them.
    size = F.ceil(F.greatest(F.regexp_count(text_of(), F.lit(WORD)), F.lit(1)) / PASSAGE)
    fitting = F.sum(size).over(Window.orderBy(size, "doc_id")) <= passages
    kept = some.select("doc_id", fitting.alias("_fits")).filter("_fits").select("doc_id")
    rows = some.join(F.broadcast(kept), "doc_id").select(bags(text_of()).alias("x"), "y").toPandas()
    own = [np.asarray(b, dtype=np.float32).reshape(-1, N_FEATURES) for b in rows["x"]]
    x = np.concatenate(own) if own else np.zeros((0, N_FEATURES), dtype=np.float32)
    return fit(x, np.repeat(np.arange(len(own)), [len(b) for b in own]), rows["y"].to_numpy(dtype=np.float32))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of docs, repeated ones too.

    docs has doc_id and text, labels doc_id and quality; other columns are
    ignored, and nothing but the text enters a score. A null text counts as
    empty, and an empty one is scored like any other. A null doc_id counts as
    the empty text in the remainder, so it is not held out. A very long text is
    encoded in pieces of whole passages. An empty table
    gives an empty result; without labels of both kinds all scores are their
    mean, or 0.5.
    """
    model = train(docs, labels, most)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)))

    scored = docs.select("doc_id", (remainder("doc_id", FOLDS) == 1).alias("held_out"), score(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
