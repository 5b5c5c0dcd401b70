import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import mil_quality, quality_rules
from panelspark.llm.labels import labelled_sample
from tests.llm.helpers import EDGES, docs, words

LABELS = "doc_id long, quality int, toxic int, text string, y int"


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0, "t", 5) for i, q in rows], LABELS)


def noisy(seed):
    rng = random.Random(seed)
    return " ".join(w + rng.choice(("###", "$$$", "&&&", "%%%")) for w in words(seed, 150).split())


def corpus(n=300):
    good = [(i, ". ".join(words(i, 60).split(" ", 40)[:40]) + " " + words(i + 5000, 120)) for i in range(n)]
    return good + [(n + i, noisy(i)) for i in range(n // 3)], [(i, 1) for i in range(n)] + [(n + i, 0) for i in range(n // 3)]


def held_out(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 1


def base_counts(t):
    t = t or ""
    space = " \t\n\x0b\x0c\r"
    w = "".join(" " if c in space else c for c in t).split(" ")
    w = [x for x in w if x]
    lines = [x for x in t.split("\n") if x.strip(space)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x85 <", max_size=80))
def test_base_counts(text):
    assert quality_rules.statistics(text)[0] == base_counts(text)


def test_rules_keep_good_documents(spark):
    table, known = corpus()
    table += [(i and 20_000 + i, t) for i, t in EDGES] + [(9000, None), (9001, "same words again " * 40)]
    got = quality_rules.judge(docs(spark, table), labels(spark, known)).collect()
    assert len(got) == len(table)
    by_id = {r["doc_id"]: r for r in got}
    # Repeated ids have a row for each of their texts.
    assert Counter((r["doc_id"], *[r[c] for c in quality_rules.BASE]) for r in got) == Counter((i, *base_counts(t)) for i, t in table)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert np.mean([by_id[i]["kept"] == bool(q) for i, q in known if i > 10]) > 0.98
    kept = quality_rules.keep_good(docs(spark, table), labels(spark, known))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert kept.columns == docs(spark, []).columns


def test_trees_are_monotonic_and_flat_scoring_agrees_with_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] - 0.7 * x[:, 1] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.normal(size=3000) > 0.2).astype(float)
    m = quality_rules.fit(x, y, [1, -1, 0])
    grid = np.linspace(0, 1, 200)
    for a in rng.random((20, 3)):
        for j, sign in ((0, 1), (1, -1)):
            z = np.tile(a, (200, 1))
            z[:, j] = grid
            assert (sign * np.diff(m.probability(z)) >= -1e-12).all()
    for a in x[:50]:
        s = m.base
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if a[m.feature[at]] <= m.threshold[at] else m.right[at]
            s += m.value[at]
        assert m.probability(a[None])[0] == pytest.approx(1 / (1 + np.exp(-s)))
    assert np.mean((m.probability(x) > 0.5) == y) > 0.85


@pytest.mark.parametrize("run", [quality_rules.judge, mil_quality.classify])
def test_no_labels_one_label_and_no_documents(spark, run):
    few = docs(spark, EDGES[:5])
    for known in ([], [(4, 1)], [(4, None), (None, 1)]):
        out = run(few, labels(spark, known)).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert run(docs(spark, []), labels(spark, [(1, 1), (2, 0)])).collect() == []


def test_attention_classifier_on_held_out_documents(spark):
    table, known = corpus()
    got = mil_quality.classify(docs(spark, table + EDGES), labels(spark, known)).collect()
    assert len(got) == len(table) + len(EDGES)
    truth = dict(known)
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 10]
    assert np.mean(right) > 0.97
    for r in got:
        assert r["held_out"] == held_out(r["doc_id"], 3) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_held_out_labels_teach_nothing(spark):
    table, known = corpus(90)
    flipped = [(i, 1 - q if held_out(i, 3) else q) for i, q in known]
    pick = lambda lab: sorted((r["doc_id"], r["score"]) for r in mil_quality.classify(docs(spark, table), labels(spark, lab)).collect())
    assert pick(known) == pick(flipped)


def test_gradients():
    rng = np.random.default_rng(1)
    x, owner = mil_quality.encode([words(i, 30 + 40 * i) for i in range(6)])
    y = np.array([0, 1, 0, 1, 1, 0], dtype=np.float32)
    loss = lambda m: -np.mean(np.log(np.where(y > 0, s := m.forward(m.standard(x), owner, 6)["score"], 1 - s)))
    assert loss(mil_quality.fit(x, owner, y, epochs=60)) < 0.3 * loss(mil_quality.fit(x, owner, y, epochs=1))
    f = mil_quality.fit(x, owner, y, epochs=5).forward(rng.normal(size=x.shape).astype(np.float32), owner, 6)
    assert np.allclose(np.add.reduceat(f["weight"], f["starts"]), 1, atol=1e-5)


def test_passages_cover_whole_texts():
    x, owner = mil_quality.encode(["", words(1, 64), words(2, 65), "é " * 1000])
    assert np.bincount(owner).tolist() == [1, 1, 2, 16]
    one = mil_quality.encode([words(2, 65)])[0]
    assert np.allclose(one, x[owner == 2], atol=1e-6)


def test_long_texts_encode_in_pieces_like_whole_ones(monkeypatch):
    rng = random.Random(1)
    texts = ["  lead " + "".join(rng.choice(["alpha", "Beta9", "é世", "x" * 40]) + rng.choice([" ", "\n", "  \t"]) for _ in range(n)) + end for n, end in ((9000, " end"), (640, ""), (64, ""))]
    texts += ["", " ", "word " * 63, "w" * 20_000 + " b", "w "  * 6000]
    whole = [mil_quality.encode([t])[0] for t in texts]
    monkeypatch.setattr(mil_quality, "PIECE", 3000)
    assert all(np.array_equal(a, mil_quality.encode_long(t)) for a, t in zip(whole, texts, strict=True))


def test_one_row_of_a_labelled_id_is_learned_from(spark):
    df = docs(spark, [(1, f"text {i}") for i in range(50)] + [(2, None), (2, None), (3, "c")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 1)], "doc_id long, quality int")
    got = labelled_sample(df, labels, "quality", 10).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(1, 1), (2, 0)]


def test_the_one_passage_that_bears_the_label_is_learned_from_in_texts_of_10_000(spark):
    """Bad documents differ from good ones in one passage; the two long texts hold theirs where no even spread of 48 would look."""
    plain = lambda seed, n: " ".join(words(seed, 64) for _ in range(n)) if n < 50 else " ".join([words(seed, 6400)] * (n // 100))
    bad = " ".join(["####"] * 64)
    table, marks, i = [], [], 0
    for seed in range(120):
        i += 1
        n = 4 + seed % 9
        own = [words(seed * 20 + k, 64) for k in range(n)]
        if seed % 2:
            own[seed % n] = bad
        table.append((i, " ".join(own)))
        marks.append((i, 1 - seed % 2))
    long = plain(9, 5_000)
    table += [(1001, f"{long} {bad} {long}"), (1002, f"{long} {long}")]
    marks += [(1001, 0), (1002, 1)]
    own = mil_quality.encode_long(table[-2][1])
    assert 10_000 <= len(own) <= 10_010
    model = mil_quality.train(docs(spark, table), labels(spark, marks))
    low, high = model.score([table[-2][1], table[-1][1]])
    assert low < high
    # A bound on passages leaves out whole documents, the longest first.
    few = mil_quality.train(docs(spark, table), labels(spark, marks), passages=2_000)
    assert few.score([table[0][1]])[0] > 0.5 > few.score([table[1][1]])[0]
