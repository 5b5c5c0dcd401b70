import re
from collections import Counter

import duckdb
import public_tokenizers

import corpus_pipeline
from panelspark.llm import bpe, mixing, quality_rules
from tests.llm.helpers import EDGES, docs, words
from tests.llm.test_dedup import plain_components, plain_fingerprint
from tests.llm.test_licenses_secrets import spans
from tests.llm.test_quality import noisy

V = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def corpus():
    out = [(100 + i, words(i, 120 + i) + (' token = "24be64439e3e49cf46b2d7c90f3602a3" end' if i % 3 == 0 else ""), f"s{i % 4}" if i % 7 else None) for i in range(120)]
    out += [(1000 + i, out[i % 9][1], f"s{i % 3}") for i in range(60)]
    out += [(2000 + i, noisy(i), "s1") for i in range(60)]
    return out + [(i and 5000 + i, t, "e") for i, t in EDGES]


def redacted(t):
    merged = []
    for a, _, b, _ in spans(t):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        t = t[:a] + "[SECRET]" + t[b:]
    return t


def test_each_stage_and_the_whole(spark, tmp_path):
    table = corpus()
    known = [(i, 0 if 2000 <= i < 3000 else 1) for i, t, _ in table if i is not None and i < 5000]
    docs(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(known, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    frames, df = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = df.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        df = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        frames.append(df)
    assert all(f.columns == columns for f in frames[:-1])
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in f.collect()] for f in frames[:-1]]

    good = Counter(r for r in table if len((r[1] or "").split()) >= 50 and quality_rules.repeated_words(r[1].encode().split()) * 2 <= len(r[1].split()) and not (r[0] and 2000 <= r[0] < 3000))
    assert Counter(rows[0]) == good

    fps = [(i, plain_fingerprint(t)) for i, t, _ in rows[0]]
    first, roots = plain_components(fps)
    assert Counter(r[0] for r in rows[1]) == Counter(first[root] for root in set(roots.values()))
    assert set(rows[1]) <= set(rows[0])

    assert Counter(rows[2]) == Counter((i, redacted(t), s) for i, t, s in rows[1])
    assert any("[SECRET]" in t for _, t, _ in rows[2]) and not any(re.search("24be64439e3e49cf", t) for _, t, _ in rows[2])

    size = lambda t: len(t.encode().split())
    taken = Counter()
    for _, t, s in rows[3]:
        taken[s] += size(t)
    con = duckdb.connect()
    con.register("d", frames[2].toPandas())
    targets = {r[1]: r[2] for r in con.sql(f"SELECT DISTINCT d.doc_id, d.source, o.target FROM ({mixing.ORACLE.format(docs='d')}) o JOIN d ON d.doc_id IS NOT DISTINCT FROM o.doc_id").fetchall()}
    assert all(abs(taken[s] - t) <= max(size(x) for _, x, y in rows[2] if y == s) for s, t in targets.items())
    assert max(Counter(rows[3]).values()) <= 2 and set(rows[3]) <= set(rows[2])

    enc = bpe._encoding(*V)
    want = Counter((i, bpe._raw(enc.encode_ordinary(t))) for i, t, _ in rows[3])
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in frames[4].collect()) == want

    import hashlib

    whole = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert whole == Counter({(i, len(b) // 4, hashlib.sha256(b).hexdigest()): n for (i, b), n in want.items()})


def test_no_documents(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
