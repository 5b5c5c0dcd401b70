from collections import defaultdict

import duckdb
import pytest

from panelspark.llm import mixing
from tests.llm.helpers import EDGES, docs, words


def corpus():
    out = [(i, words(i, 3 + i % 60), None if i % 11 == 0 else f"s{i % 5}") for i in range(400)]
    return out + [(1000 + i, words(i, 50), "hot") for i in range(300)] + [(2000, "", "empty"), (2001, None, "empty")]


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Resharing in rounds, as stated."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    t, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return t | {s: level * w[s] for s in free}
        t |= {s: cap * sizes[s] for s in over}
        left -= sum(t[s] for s in over)
        free -= over
    return t


def test_targets_and_taken(spark):
    got = mixing.mix(docs(spark, corpus())).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    want = targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 31


def test_same_again_and_as_sql(spark):
    df = docs(spark, corpus())
    pick = lambda d: sorted((r["doc_id"], r["size"], r["taken"]) for r in d.collect())
    first = pick(mixing.mix(df))
    assert first == pick(mixing.mix(df.repartition(7)))
    con = duckdb.connect()
    con.register("d", df.toPandas())
    sql = con.sql(mixing.ORACLE.format(docs="d")).fetchall()
    assert first == sorted((r[0], r[1], r[4]) for r in sql)


def test_unequal_chances_favour_longer_texts(spark):
    table = [(i, words(i, 10 if i % 2 else 90), "a") for i in range(1500)] + [(5000 + i, words(i, 50), "b") for i in range(600)]
    got = [r for r in mixing.mix(docs(spark, table), weights=(1, 1), share=1.0).collect() if r["source"] == "a"]
    share = lambda n: sum(r["copies"] > 0 for r in got if r["size"] == n) / sum(r["size"] == n for r in got)
    assert share(90) > share(10) > 0


def test_inclusion_probabilities_expect_the_rest(spark):
    table = [(i, words(i, 3 + i % 97), "a") for i in range(900)] + [(5000, words(1, 4000), "a")] + [(6000 + i, words(i, 20), "b") for i in range(100)]
    df = docs(spark, table)
    sizes = df.selectExpr("source", "cast(size(split(text, ' ')) as bigint) as size")
    plan = mixing.source_plan(sizes, (1, 1), 0.9).cache()
    factors = {r["source"]: r["factor"] for r in mixing.inclusion_factors(sizes, plan).collect()}
    for r in plan.filter("part > 0").collect():
        expected = sum(x["size"] * min(1.0, factors[r["source"]] * x["size"] ** 0.5) for x in sizes.filter(f"source = '{r['source']}'").collect())
        assert r["rest"] > 0 and expected == pytest.approx(r["rest"], rel=1e-9)


def test_many_like_rows_are_counted_not_sorted(spark):
    table = [(None, words(1, 40), "a")] * 3000 + [(i, words(i, 40), "a") for i in range(50)] + [(10_000 + i, words(i, 30), "b") for i in range(200)]
    got = mixing.mix(docs(spark, table), weights=(1, 3), share=0.7).collect()
    assert len(got) == len(table)
    taken = sum(r["taken"] for r in got if r["source"] == "a")
    target = next(r["target"] for r in got if r["source"] == "a")
    assert abs(taken - target) <= 20 and len({r["copies"] for r in got if r["doc_id"] is None}) == 2


def test_edges(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    got = mixing.mix(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r["taken"] == 0 for r in got if r["size"] == 0)


def test_repeat_returns_rows_as_often_as_taken(spark):
    df = docs(spark, corpus() + [(1000, words(0, 50), "hot")] * 2)
    out = mixing.repeat(df)
    assert out.columns == df.columns
    words_out = sum(len(r["text"].split()) for r in out.collect())
    total = sum(len((r["text"] or "").split()) for r in df.collect())
    assert words_out == pytest.approx(1.5 * total, rel=0.05)
