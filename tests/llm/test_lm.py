import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import lbl
from tests.llm.helpers import EDGES, docs, words


def plain(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def in_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def test_counts_and_base_scores_match_a_plain_loop(spark):
    table = [(i, words(i, 5 + i % 90) + f" Rare{i} THE") for i in range(150)] + EDGES
    got = lbl.score(docs(spark, table), common=20).collect()
    assert len(got) == len(table)
    c, ends = Counter(), 0
    for i, t in table:
        if in_training(i):
            c.update(plain(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    want = Counter()
    for i, t in table:
        w = plain(t)
        want[(i, not in_training(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(log(c[x]) for x in w) + log(ends), 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def held_log10(counts_by_context, unigram, texts):
    """log10 per token of an interpolated bigram, half and half, and of its add-half unigram alone."""
    both = alone = n = 0
    for words in texts:
        last = b"<s>"
        for w in [*words, b"</s>"]:
            own = counts_by_context.get(last, Counter())
            u = unigram(w)
            both += math.log10(0.5 * own[w] / max(1, own.total()) + 0.5 * u)
            alone += math.log10(u)
            n, last = n + 1, w
    return both / n, alone / n


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_texts_score_better_than_with_an_interpolated_bigram(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    bigrams, c = {}, Counter()
    for r in rows:
        if in_training(r["doc_id"]):
            words = plain(r["text"])
            c.update([*words, b"</s>"])
            for a, b in zip([b"<s>", *words], [*words, b"</s>"], strict=True):
                bigrams.setdefault(a, Counter())[b] += 1
    n, v = c.total(), len(c)
    bigram, unigram = held_log10(bigrams, lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1)), [plain(r["text"]) for r in rows if not in_training(r["doc_id"])])
    held = lbl.score(df).filter("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert abs(held[1] / held[0] - unigram) < 1e-6
    assert held[2] / held[0] < 0 and held[2] / held[0] > bigram


def test_rare_words_score_alike_by_join_and_by_broadcast(spark):
    df = docs(spark, [(i, words(i, 40) + f" Rare{i % 7}x{i} seen{i % 70}") for i in range(140)] + EDGES)

    def pick(common):
        return sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in lbl.score(df, common=common).collect())

    assert pick(10_000) == pick(450)
    # The words with vectors of their own are the same either way, so the scores are too.
    wide, narrow = ({(r["doc_id"], r["n_tokens"]): round(r["score"], 2) for r in lbl.score(df, common=c).collect()} for c in (10_000, 700))
    assert wide == narrow


def small_model(n_own=400, seed=0):
    rng = np.random.default_rng(seed)
    mass = np.concatenate([[0, 50], 1000 / np.arange(1, n_own), np.full(lbl.CLASSES, 0.5)])
    model = lbl.Model.new(mass)
    model.r, model.q = (rng.normal(0, 0.3, model.r.shape).astype(np.float32) for _ in range(2))
    return model, mass


def test_probabilities_sum_to_one_and_agree_with_the_plain_softmax():
    model, _ = small_model()
    normal, n = lbl.Normaliser(model), len(model.b)
    for before, last in ((0, 0), (3, 9), (n - 1, 1)):
        log = normal.log10(np.full(n - 1, before), np.full(n - 1, last), np.arange(1, n))
        assert abs((10.0**log).sum() - 1) < 1e-4
        h = model.r[last] * model.c[0] + model.r[before] * model.c[1]
        s = (model.q @ h + model.b + model.log_unigram).astype(float)[1:]
        assert np.abs(log - (s - np.log(np.exp(s).sum())) / np.log(10)).mean() < 0.05


def test_a_words_chances_in_its_class_sum_to_one(spark):
    df = docs(spark, [(i, words(i, 30) + f" once{i} twice{i // 2}") for i in range(120)])
    counts = lbl.word_counts(df.select("text"))
    lex = lbl.lexicon(counts, 120)
    rows = [r for r in counts.collect()]
    own = set(lex.hashes[lex.kinds < lex.first_class].tolist())
    sums = 10.0**lex.unknown_log10
    for r in rows:
        if r["h"] not in own:
            sums[r["cls"]] += (r["n"] - lex.discount) / 10.0 ** lex.class_log10[r["cls"]]
    assert np.allclose(sums, 1)
    assert abs(lex.mass[2:].sum() - 0.5 * lbl.CLASSES - sum(r["n"] for r in rows)) < 1e-6 + lex.discount * len(rows)


def test_learning_finds_a_chain():
    rng = np.random.default_rng(0)
    chain = [2]
    for _ in range(60_000):
        chain.append(int((chain[-1] * 3 + rng.integers(0, 3)) % 50) + 2)
    seq = np.array([0, 0, *chain], dtype=np.int32)
    mass = np.concatenate([[0, 0.5], np.bincount(chain, minlength=52)[2:] + 0.5, np.full(lbl.CLASSES, 0.5)])
    zero = np.zeros(len(mass))
    lex = lbl.Lexicon(*(np.zeros(0, dtype=np.int64),) * 3, mass, zero.astype(np.int32), zero, 52, 0.5, zero, zero, 0, 0, 0)
    model = lbl.fit(seq, lex, lbl.Model.new(mass), 4)
    log = lbl.Normaliser(model).log10(seq[:-2], seq[1:-1], seq[2:])
    assert log.mean() > np.log10(mass[seq[2:]] / mass.sum()).mean() + 0.3


def test_long_texts_split_like_whole_ones(monkeypatch):
    text = " ".join(f"W{i}\n" + "x" * (i % 40) for i in range(2000))
    whole = [w for part in lbl.tokens(text) for w in part]
    monkeypatch.setattr(lbl, "PIECE", 50)
    assert [w for part in lbl.tokens(text) for w in part] == whole == text.encode().lower().split()


def test_no_documents_and_no_training_documents(spark):
    assert lbl.score(docs(spark, [])).collect() == []
    only = [i for i in range(200) if not in_training(i)][:3]
    got = lbl.score(docs(spark, [(i, "a b") for i in only])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)] * 3


def test_the_first_sample_is_bounded_whatever_the_ids():
    rows = iter([{"types": np.arange(50, dtype=lbl.CODE).tobytes()}] * 100)
    assert len(lbl._first(rows, 120)) == 120 and len(list(rows)) == 97
    assert len(lbl._first(iter([]), 10)) == 0
