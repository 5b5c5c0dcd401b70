"""LM scoring: a log-bilinear model of words trained in numpy with noise-contrastive estimation.

The commonest words are types of their own, with a context and a target vector
each; rarer words, and those never seen, share hashed classes by their first
and last bytes, which have vectors too. The model predicts a type from the two
before it. Counts are discounted (Ney's absolute discount): what is taken from
the words of a class is the chance of an unknown word in it, so the
probabilities of all training words and of one unknown word for each class sum
to one after every context.

Training begins on the driver, on a bounded sample of texts, and goes on in the
tasks: each continues from there over all of its training texts and passes on
its vectors, which are averaged by how often a task met a type. So the work of
training, and the evidence in the vectors, grow with the corpus. Token
probabilities are normalised by batched matrix products on two levels: groups
of types with alike target vectors, then the types of the group. A group's mass
is the second-order expansion of the sum over its types.

Counts of common words travel with the tasks; the rest of a document's words
meet their counts in a join, so any vocabulary will do. Texts are read twice:
for the counts, and to be written as types, which training and scoring read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelspark.llm.common import map_texts, remainder, saved, text_of

FOLDS = 5
PAD, END = 0, 1
#: Words with vectors of their own, at most; how often such a word occurs, at least; classes of all others.
FREQUENT, LEAST, CLASSES = 14_336, 3, 1_024
#: Words whose counts travel with the scoring tasks, at most.
COMMON = 1 << 18
#: Distinct words that a counting task holds before it passes its sums on.
HELD = 400_000
#: Training tokens that the driver begins on, about.
SAMPLE = 2_000_000
WIDTH, BATCH, RATE, SEED = 24, 2_048, 0.1, 3
#: Noise types in a step of the driver and of a task.
NOISE, FEW_NOISE = 128, 20
#: The driver goes over a sample of n tokens about sqrt(PASSES / n) times.
PASSES = 12_000_000
#: The rate of the tasks, as a part of the driver's.
LATER = 0.5
#: Types in a group of the normalisation, at most; tokens normalised at a time; types in a row of vectors.
GROUP, AT_ONCE, ROW = 192, 32_768, 512
#: Code points of a text that are split into words at a time, about.
PIECE = 1 << 20


def word_class(word: bytes) -> int:
    """A class from the first byte and the last three."""
    return xxh64_intdigest(word[:1] + b"|" + word[-3:], 7) % CLASSES


def word_hash(word: bytes) -> int:
    """XXH64 as a signed number. Words are told apart by it."""
    h = xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def tokens(text: str) -> Iterator[list[bytes]]:
    """The words, A-Z in lower case, of one piece of the text after another."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end].encode().lower().split()
        at = end


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, cls, n): how often each word occurs. Tasks pass on sums of at most ``HELD`` words at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            pdf = pd.DataFrame({"h": np.fromiter(map(word_hash, held), np.int64, len(held)), "cls": np.fromiter(map(word_class, held), np.int32, len(held)), "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return pdf

        for pdf in batches:
            for text in pdf["text"]:
                for words in tokens(text):
                    held.update(words)
                    if len(held) > HELD:
                        yield out()
        if held:
            yield out()

    return map_texts(texts, count, "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


class Coder:
    """Codes of the words that a task has met, and what the lexicon has of each, kept from one batch to the next; at most about ``HELD`` words."""

    def __init__(self, words: Lexicon) -> None:
        self.words = words
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.known = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the code of every word, words of each text). Codes are places in hash, count, kind and cls."""
        if len(self.codes) > HELD:
            self._forget()
        codes, sizes, parts = self.codes, [], [np.zeros(0, dtype=np.int64)]
        for t in texts:
            own = [np.fromiter([codes.setdefault(w, len(codes)) for w in words], np.int64, len(words)) for words in tokens(t)]
            sizes.append(sum(map(len, own)))
            parts += own
        fresh = list(islice(codes, len(self.known[0]), None))
        self.known = tuple(np.concatenate(x) for x in zip(self.known, self.words.look_up(fresh), strict=True))
        return np.concatenate(parts), np.array(sizes, dtype=np.int64)

    @property
    def hash(self) -> np.ndarray:
        return self.known[0]

    @property
    def count(self) -> np.ndarray:
        """How often a word occurs in training, or -1 where it isn't common."""
        return self.known[1]

    @property
    def kind(self) -> np.ndarray:
        return self.known[2]

    @property
    def cls(self) -> np.ndarray:
        return self.known[3]


def type_sequence(kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(types, text of each): every text stands between two pads and an end."""
    owner = np.repeat(np.arange(len(sizes)), sizes + 3)
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    seq = np.full(len(owner), PAD, dtype=np.int32)
    seq[np.arange(len(kinds)) + 3 * np.repeat(np.arange(len(sizes)), sizes) + 2] = kinds
    seq[starts + sizes + 2] = END
    return seq, owner


@dataclass
class Lexicon:
    """Counts that every task has: those of common words by hash, and the totals of classes."""

    hashes: np.ndarray
    counts: np.ndarray
    #: The type of a common word: its own, or its class.
    kinds: np.ndarray
    #: By type: discounted count; the class of an own word; the chance that a training token counts as its class.
    mass: np.ndarray
    class_of: np.ndarray
    shared: np.ndarray
    first_class: int
    discount: float
    #: By class: log10 of its mass and of its unknown word's chance.
    class_log10: np.ndarray
    unknown_log10: np.ndarray
    total: int
    distinct: int
    ends: int

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, count or -1 where it isn't common, type, class) of each word."""
        h = np.fromiter(map(word_hash, words), np.int64, len(words))
        cls = np.fromiter(map(word_class, words), np.int64, len(words))
        kinds = cls + self.first_class
        at = np.searchsorted(self.hashes, h)
        found = np.zeros(len(h), dtype=bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == h[inside]
        counts = np.full(len(h), -1, dtype=np.int64)
        counts[found] = self.counts[at[found]]
        kinds[found] = self.kinds[at[found]]
        return h, counts, kinds, cls

    def base_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def lexicon(counts: DataFrame, ends: int, common: int = COMMON) -> Lexicon:
    """The counts of the commonest words, at most ``common``, and totals over all of them."""
    totals = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).toPandas()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[totals["cls"]], class_v[totals["cls"]] = totals["n"], totals["v"]
    once, twice = int(totals["once"].sum()), int(totals["twice"].sum())
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    total, distinct = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("k")).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("n")).orderBy(F.desc("k")).toPandas()
    fits = steps[steps["v"].cumsum() <= common]
    top = counts.filter(F.col("n") >= int(fits["n"].min())).toPandas() if len(fits) else counts.limit(0).toPandas()
    top = top.astype({"h": np.int64, "cls": np.int64, "n": np.int64}).sort_values(["n", "h"], ascending=[False, True]).reset_index(drop=True)
    n_own = min(FREQUENT, int((top["n"] >= LEAST).sum()))
    own, first_class = top[:n_own], 2 + n_own
    class_n -= np.bincount(own["cls"], own["n"], CLASSES)
    class_mass = class_n + discount * np.bincount(own["cls"], minlength=CLASSES) + 0.5
    kinds = np.where(np.arange(len(top)) < n_own, 2 + np.arange(len(top)), first_class + top["cls"])
    by_hash = np.argsort(top["h"].to_numpy())
    pad = lambda x, y: np.concatenate([[0, 0], x, np.full(CLASSES, y)])
    mass = np.concatenate([[0.0, max(ends, 0.5)], own["n"] - discount, class_mass])
    return Lexicon(
        *(np.asarray(x)[by_hash] for x in (top["h"], top["n"], kinds)),
        mass, pad(first_class + own["cls"], 0).astype(np.int32), pad(discount / own["n"], 0.0), first_class, discount,
        np.log10(class_mass), np.log10((discount * class_v + 0.5) / class_mass), total, distinct, ends,
    )


def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indexes, the sum of their rows)."""
    order = np.argsort(index.astype(np.uint16) if index.max(initial=0) < 1 << 16 else index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(values[order], first, axis=0)


@dataclass
class Model:
    """Context and target vectors, a diagonal for each of the two context places, biases above the log unigram.

    After them the state of training: sums of squared gradients, and how often
    each type was met since the model was sent out.
    """

    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray
    log_unigram: np.ndarray
    r_seen: np.ndarray
    q_seen: np.ndarray
    c_seen: np.ndarray
    met: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def new(cls, mass: np.ndarray, seed: int = SEED) -> Model:
        rng, n = np.random.default_rng(seed), len(mass)
        part = mass / mass.sum()
        return cls(*(rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32) for _ in range(2)), np.repeat(np.array([[1.0], [0.5]], dtype=np.float32), WIDTH, axis=1), np.zeros(n, np.float32), np.log(np.maximum(part, 1e-12)).astype(np.float32), *(np.full(n, 1e-6, np.float32) for _ in range(2)), np.full((2, WIDTH), 1.0, np.float32))

    def copy(self) -> Model:
        return replace(self, **{k: getattr(self, k).copy() for k in ("r", "q", "c", "b", "r_seen", "q_seen", "c_seen")}, met=np.zeros(len(self.b)))

    def step(self, seq: np.ndarray, words: Lexicon, cdf: np.ndarray, rng: np.random.Generator, rate: float, n_noise: int = NOISE) -> None:
        """One step of noise-contrastive estimation on the targets seq[2:]; one set of noise types, drawn from the unigram, for all."""
        target = seq[2:]
        valid = (target != PAD).astype(np.float32)
        target = np.where(rng.random(len(target), dtype=np.float32) < words.shared[target], words.class_of[target], target)
        noise = np.minimum(np.searchsorted(cdf, rng.random(n_noise)), len(cdf) - 1)
        near = self.r.take(seq, axis=0)
        h = near[1:-1] * self.c[0] + near[:-2] * self.c[1]
        q, q_noise = self.q.take(target, axis=0), self.q.take(noise, axis=0)
        # The log unigram is part of the score and of the noise, so it cancels.
        own = np.einsum("ij,ij->i", h, q) + self.b[target] - math.log(n_noise)
        other = h @ q_noise.T + (self.b[noise] - math.log(n_noise))
        d_own = -valid / (1 + np.exp(np.clip(own, -30, 30)))
        d_other = valid[:, None] / (1 + np.exp(-np.clip(other, -30, 30)))
        dh = d_own[:, None] * q + d_other @ q_noise
        index = np.concatenate([target, noise])
        at, g = _sums(index, np.concatenate([d_own[:, None] * h, d_other.T @ h]))
        self.q_seen[at] += np.einsum("ij,ij->i", g, g) / WIDTH
        self.q[at] -= rate * g / np.sqrt(self.q_seen[at])[:, None]
        bias = np.bincount(index, np.concatenate([d_own, d_other.sum(axis=0)]), len(self.b))[at]
        self.b[at] -= 0.5 * rate * bias / np.sqrt(1 + words.mass[at])
        back = np.zeros_like(near)
        back[1:-1] = dh * self.c[0]
        back[:-2] += dh * self.c[1]
        at, g = _sums(seq, back)
        self.r_seen[at] += np.einsum("ij,ij->i", g, g) / WIDTH
        self.r[at] -= rate * g / np.sqrt(self.r_seen[at])[:, None]
        g = np.stack([(near[1:-1] * dh).sum(axis=0), (near[:-2] * dh).sum(axis=0)])
        self.c_seen += g**2
        self.c -= 0.2 * rate * g / np.sqrt(self.c_seen)
        if len(self.met):
            self.met += np.bincount(index, minlength=len(self.b))

    def average(self, blocks: pd.DataFrame) -> Model:
        """This model with the vectors that ``blocks`` (block, sums; see :func:`tasks_vectors`) averages to."""
        out = self.copy()
        for block, raw in zip(blocks["block"], blocks["sums"], strict=True):
            x = np.frombuffer(raw, dtype=np.float64).reshape(-1, 2 * WIDTH + 2)
            if block < 0:
                if x[0, 0]:
                    out.c = (x[:, 1 : 1 + WIDTH] / x[:, :1]).astype(np.float32)
                continue
            at = block * ROW + np.flatnonzero(x[:, 0] > 0)
            mean = (x[x[:, 0] > 0] / x[x[:, 0] > 0][:, :1]).astype(np.float32)
            out.r[at], out.q[at], out.b[at] = mean[:, 1 : 1 + WIDTH], mean[:, 1 + WIDTH : -1], mean[:, -1]
        return out


def fit(seq: np.ndarray, words: Lexicon, model: Model, passes: float) -> Model:
    """The model trained ``passes`` times on a type sequence, its pieces in another order each time; the rate falls to a tenth."""
    rng = np.random.default_rng(SEED)
    cdf = np.cumsum(words.mass / words.mass.sum())
    starts = np.arange(0, len(seq) - 2, BATCH)
    steps = math.ceil(passes * len(starts))
    order = np.concatenate([rng.permutation(starts) for _ in range(math.ceil(passes))])[:steps] if steps else []
    for no, a in enumerate(order):
        model.step(seq[a : a + BATCH + 2], words, cdf, rng, RATE * (1 - 0.9 * no / steps))
    return model


def groups(q: np.ndarray, most: int = GROUP) -> list[np.ndarray]:
    """The types (without the pad) in groups of at most ``most`` with alike vectors: halves along the main axis, again and again."""
    done, open_ = [], [np.arange(1, len(q))]
    while open_:
        own = open_.pop()
        if len(own) <= most:
            done.append(own)
            continue
        x = q[own].astype(np.float64)
        x -= x.mean(axis=0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        order = np.argsort(x @ axis, kind="stable")
        open_ += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return done


class Normaliser:
    """log10 P(type | two types before), summing to one over the types after every context."""

    def __init__(self, model: Model) -> None:
        self.members = groups(model.q)
        self.last, self.before = model.r * model.c[0], model.r * model.c[1]
        self.group, self.place = np.zeros(len(model.b), dtype=np.int32), np.zeros(len(model.b), dtype=np.int32)
        bias = model.b + model.log_unigram
        self.weights, first, second, mass = [], [], [], []
        for no, own in enumerate(self.members):
            self.group[own], self.place[own] = no, np.arange(len(own))
            q, b = model.q[own], bias[own].astype(np.float64)
            part = np.exp(b - b.max())
            mass.append(math.log(part.sum()) + b.max())
            part /= part.sum()
            first.append(part @ q)
            second.append(part @ (q - first[-1]) ** 2)
            # The bias goes with a context entry that is always one.
            self.weights.append(np.ascontiguousarray(np.concatenate([q.T, bias[own][None, :]])))
        self.over = np.concatenate([np.array(first).T, np.array(mass)[None, :], np.array(second).T / 2]).astype(np.float32)

    @staticmethod
    def _log_softmax_at(h: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        scores = h @ weights
        own = scores[np.arange(len(at)), at]
        with np.errstate(over="ignore"):
            sums = np.exp(scores, out=scores) @ np.ones(scores.shape[1], dtype=np.float32)
        if np.isfinite(sums).all() and sums.all():
            return own - np.log(sums)
        # Out of the range of single precision: the largest score goes first.
        scores = h @ weights
        top = scores.max(axis=1)
        return own - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))

    def log10(self, before: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for a in range(0, len(target), AT_ONCE):
            t = target[a : a + AT_ONCE]
            order = np.argsort(self.group.take(t).astype(np.uint16), kind="stable")
            t = t.take(order)
            g = self.group.take(t)
            h = np.ones((len(t), WIDTH + 1), dtype=np.float32)
            h[:, :WIDTH] = self.last.take(last[a : a + AT_ONCE].take(order), axis=0)
            h[:, :WIDTH] += self.before.take(before[a : a + AT_ONCE].take(order), axis=0)
            cuts = np.searchsorted(g, np.arange(len(self.members) + 1))
            log = np.empty(len(t), dtype=np.float64)
            for z in range(0, len(t), 2_048):
                x = h[z : z + 2_048]
                log[z : z + 2_048] = self._log_softmax_at(np.concatenate([x, np.square(x[:, :WIDTH])], axis=1), self.over, g[z : z + 2_048])
            for no in np.flatnonzero(cuts[1:] > cuts[:-1]):
                own = slice(cuts[no], cuts[no + 1])
                log[own] += self._log_softmax_at(h[own], self.weights[no], self.place.take(t[own]))
            out[a + order] = log / math.log(10)
        return out


#: Types as they are written, two bytes each.
CODE = "<u2"
CODED = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, in_class double, types binary, rest array<long>, times array<int>, cls array<int>"


def coded(rows: DataFrame, sent) -> DataFrame:
    """Each row of (doc_id, held_out, text) with its types and what common words tell of it.

    base_score and in_class, the sum of log10 P(word | class), lack the words of
    ``rest``: hashes of those that aren't common, with times and class of each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = sent.value, TaskContext.get().partitionId() << 40
        code = Coder(own)
        for pdf in batches:
            codes, sizes = code(list(pdf["text"]))
            h, c, kinds, cls = code.hash, code.count, code.kind, code.cls
            base = np.where(c >= 0, own.base_log(np.maximum(c, 0)), 0.0)
            extra = np.where((c >= 0) & (kinds >= own.first_class), np.log10(np.maximum(c - own.discount, 0.01)) - own.class_log10[cls], 0.0)
            n = len(pdf)
            of = np.repeat(np.arange(n), sizes)
            seq = type_sequence(kinds[codes], sizes)[0].astype(CODE)
            out = {"doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(), "row": at + np.arange(n), "n_tokens": sizes + 1}
            at += n
            out["n_known"] = np.bincount(of, c[codes] >= 0, n).astype(np.int64) + (own.ends > 0)
            out["base_score"] = np.bincount(of, base[codes], n) + own.base_log(np.array([own.ends]))[0]
            out["in_class"] = np.bincount(of, extra[codes], n)
            out["types"] = [x.tobytes() for x in np.split(seq, np.cumsum(sizes + 3)[:-1])]
            rare = np.flatnonzero(c[codes] < 0)
            pairs, times = np.unique(of[rare] * len(h) + codes[rare], return_counts=True) if len(rare) else (np.zeros(0, dtype=np.int64),) * 2
            cuts = np.searchsorted(pairs // max(1, len(h)), np.arange(1, n))
            word = pairs % max(1, len(h))
            for name, values in (("rest", h[word]), ("times", times.astype(np.int32)), ("cls", cls[word].astype(np.int32))):
                out[name] = np.split(values, cuts)
            yield pd.DataFrame({k: list(x) if k in ("rest", "times", "cls") else x for k, x in out.items()})

    return map_texts(rows, run, CODED)


def _types(raws) -> np.ndarray:
    return np.frombuffer(b"".join(raws), dtype=CODE).astype(np.int32)


def _first(rows: Iterator, most: int) -> np.ndarray:
    """The types of rows up to the one with which they are ``most`` or more, of which the last are left out."""
    held, n = [], 0
    for r in rows:
        held.append(bytes(r["types"])[: (most - n) * np.dtype(CODE).itemsize])
        n += len(held[-1]) // np.dtype(CODE).itemsize
        if n >= most:
            break
    return _types(held)


def tasks_vectors(types: DataFrame, sent, start) -> DataFrame:
    """(block, sums): what training from ``start`` in every task gives, summed by how often the task met a type.

    A row of a block, for ``ROW`` types, has the times met, then that many
    times the context vector, the target vector and the bias; block -1 has the
    tokens of the tasks and that many times the diagonals.
    """
    schema = "block int, sums binary"

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, model = sent.value, start.value.copy()
        rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        cdf = np.cumsum(words.mass / words.mass.sum())
        trained = 0
        for pdf in batches:
            seq = _types(pdf["types"])
            for a in range(0, len(seq) - 2, BATCH):
                model.step(seq[a : a + BATCH + 2], words, cdf, rng, LATER * RATE, FEW_NOISE)
            trained += len(seq)
        if trained:
            met = model.met[:, None].astype(np.float32)
            every = np.concatenate([met, met * np.concatenate([model.r, model.q, model.b[:, None]], axis=1)], axis=1)
            both = np.zeros((2, every.shape[1]), dtype=np.float32)
            both[:, 0], both[:, 1 : 1 + WIDTH] = trained, trained * model.c
            yield pd.DataFrame({"block": [*range(math.ceil(len(every) / ROW)), -1], "sums": [*(every[a : a + ROW].tobytes() for a in range(0, len(every), ROW)), both.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, raw in zip(pdf["block"], pdf["sums"], strict=True):
                x = np.frombuffer(raw, dtype=np.float32)
                held[block] = held[block] + x if block in held else x.astype(np.float64)
        yield pd.DataFrame({"block": list(held), "sums": [x.tobytes() for x in held.values()]})

    parts = map_texts(types, train, schema)
    return parts.repartition("block").mapInPandas(add, schema)


def score(docs: DataFrame, common: int = COMMON, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of docs, repeated ones too.

    docs has doc_id and text; other columns are ignored. Learns from the rows
    that are not held out (crc32 of the id modulo ``FOLDS`` is not 1; a null id
    counts as the empty text). A null text counts as empty: one token, the end.
    Without training rows N and V are 0, so base_score is 0 throughout. An
    empty table gives an empty result. Vectors depend on how texts lie in
    partitions, within what averaging leaves; counts and base_score don't.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", FOLDS) == 1).alias("held_out"), text_of().alias("text"))
    counts = saved(word_counts(rows.filter("not held_out").select("text")), "lm-words")
    words = lexicon(counts, rows.filter("not held_out").count(), common)
    sent = spark.sparkContext.broadcast(words)
    part = saved(coded(rows, sent), "lm-types")
    model = Model.new(words.mass)
    if words.total:
        train = part.filter("not held_out").select("row", "types")
        share = min(1_000_000, math.ceil(1_000_000 * sample / words.total))
        some = train.filter(F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(1_000_000)) < share)
        seq = _first(some.select("types").toLocalIterator(), 2 * sample)
        model = fit(seq, words, model, max(1.0, math.sqrt(PASSES / max(1, len(seq)))))
        start = spark.sparkContext.broadcast(model)
        model = model.average(saved(tasks_vectors(train.select("types"), sent, start), "lm-vectors").toPandas())
    final = spark.sparkContext.broadcast(model)
    kept = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score"]

    def add_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal = Normaliser(final.value)
        for pdf in batches:
            seq = _types(pdf["types"])
            place = np.flatnonzero(seq != PAD)
            owner = np.repeat(np.arange(len(pdf)), pdf["types"].str.len() // np.dtype(CODE).itemsize)
            log = normal.log10(seq[place - 2], seq[place - 1], seq[place])
            yield pdf[kept].assign(score=pdf["in_class"].to_numpy() + np.bincount(owner[place], log, len(pdf)))

    scored = map_texts(part.select(*kept, "in_class", "types"), add_scores, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double")
    one = part.select("row", F.explode(F.arrays_zip("rest", "times", "cls")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.times").alias("times"), F.col("x.cls").alias("cls"))
    by_class = spark.createDataFrame(pd.DataFrame({"cls": np.arange(CLASSES, dtype=np.int32), "mass": words.class_log10, "unknown": words.unknown_log10}))
    rare = one.join(counts.select("h", "n"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0))).join(F.broadcast(by_class), "cls")
    in_class = F.when(F.col("n") > 0, F.log10(F.col("n") - words.discount) - F.col("mass")).otherwise(F.col("unknown"))
    added = rare.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / (words.total + 0.5 * (words.distinct + 1)))).alias("b"),
        F.sum(F.col("times") * in_class).alias("s"),
    )
    both = scored.join(added, F.col("row") == F.col("_row"), "left")
    more = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", more("n_known", "k").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), more("base_score", "b").alias("base_score"), more("score", "s").alias("score"))
