import random

import pytest
from xxhash import xxh64_intdigest

from panelspark.llm import graph, simhash
from tests.llm.helpers import EDGES, docs, words


def plain_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: (id, fingerprint) of each row. For each fingerprint the smallest id that it reaches, and its root."""
    nodes = sorted({f for _, f in fps})
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    first = {}
    for i, f in fps:
        if i is not None:
            first[find(f)] = min(first.get(find(f), i), i)
    return {f: first.get(find(f)) for f in nodes}, {f: find(f) for f in nodes}


def corpus():
    rng = random.Random(1)
    base = [words(i, 200) for i in range(8)]
    out = [(i, rng.choice(base)) for i in range(40)]
    for i in range(60):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((100 + i, " ".join(w)))
    return out + [(300 + i, words(1000 + i, 1 + i % 5)) for i in range(40)]


def test_fingerprints_and_components_match_brute_force(spark):
    table = corpus() + EDGES
    got = simhash.near_duplicates(docs(spark, table)).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in table]
    want, _ = plain_components(fps)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(((i, f"{f:016x}", want[f]) for i, f in fps), key=key)


def test_no_link_is_missed(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x, x ^ 1 << rng.randrange(64), x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = graph.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    label = {r["node"] % (1 << 64): r["label"] for r in found}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 2:
                assert label[a] == label[b]
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "fp long"), 3)


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    chain = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(chain).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert graph.components(chain.limit(0)).collect() == []


def test_one_row_of_each_component_stays(spark):
    table = corpus() + EDGES
    df = docs(spark, table)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    fps = [(i, plain_fingerprint(t)) for i, t in table]
    want, roots = plain_components(fps)
    kept = out.collect()
    assert sorted(roots[plain_fingerprint(r["text"])] for r in kept) == sorted(set(roots.values()))
    for r in kept:
        c = want[plain_fingerprint(r["text"])]
        assert r["doc_id"] == c
    assert simhash.near_duplicates(docs(spark, [])).collect() == [] and simhash.keep_one(docs(spark, [])).collect() == []
