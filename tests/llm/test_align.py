from bisect import bisect_left
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelspark.llm import align, units
from tests.llm.helpers import EDGES, docs, words

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


def plain(table):
    """Token by token; all pairs of overlapping tokens; counts over all rows."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    shown = align.Aligner(*PATHS).a.bytes
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for i, t in table:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [shown[x] for x in ids[0]], [piece(x) for x in ids[1]]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            rows.append((i, None))
            continue
        ends = [[sum(map(len, p[: n + 1])) for n in range(len(p))] if len(p) < 500 else list(_running(p)) for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in common]
        for side in (0, 1):
            for x, e in zip(ids[side], ends[side], strict=True):
                groups[bisect_left(common, e)][side].append(x)
        links, first = [], 0
        for n, e in enumerate(ends[0]):
            start = e - len(parts[0][n])
            while ends[1][first] <= start:
                first += 1
            m = first
            while m < len(ends[1]) and ends[1][m] - len(parts[1][m]) < e:
                links.append((ids[0][n], ids[1][m]))
                m += 1
        counts.update(set(links))
        shown_groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((i, (len(ids[0]), len(ids[1]), len(common), links, sha256(shown_groups.encode()).hexdigest())))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return Counter((i, *((r[0], r[1], r[2], len(r[3]), sum(counts[k] == best[k[0]] for k in r[3]), sum(counts[k] for k in r[3]), r[4]) if r else ZERO)) for i, r in rows)


def _running(parts):
    at = 0
    for p in parts:
        at += len(p)
        yield at


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


TABLE = [
    *EDGES,
    (2**60 + 1, "a large id, and <|endoftext|> or <s> or </s> as text"),
    (30, "  two  spaces\n\nlines\tand tabs \r\n end "),
    (31, "▁ stands for a space in one of them"),
    (32, "aaaa aaa aa a aaaaaaa"),
    (33, " "),
    (34, "naïve café 世界 🙂 ﬁ   \x00 nul"),
    *[(100 + i, words(i, 1 + i % 50)) for i in range(60)],
    *[(300, "one text that many rows hold")] * 30,
]


def test_equals_brute_force(spark):
    assert got(align.align(docs(spark, TABLE).repartition(3), *PATHS)) == plain(TABLE)


def test_blocks_and_stretches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_DOCS", 7)
    monkeypatch.setattr(align, "LOT", 5)
    monkeypatch.setattr(align, "spans", lambda t: units.spans(t, 50))
    table = [r for r in TABLE if len(r[1] or "") < 10_000]
    # In one process, so that what is patched holds: blocks as a task makes them.
    tool, vector, frames, own = align.Aligner(*PATHS), np.zeros(60_000, dtype=np.int64), [], None
    for i, t in table:
        own = own or align._Block(tool.n_b, tool.same)
        own.add(str(i), t or "", tool.document(t or ""), vector)
        if own.full:
            frames, own = frames + [own], None
    counts = Counter()
    for block in [*frames, own] if own else frames:
        parts = list(block.frames(0))
        for p in parts[1:]:
            assert len(p["pairs"][0]) <= 5
            counts.update(dict(zip(p["pairs"][0].tolist(), p["docs"][0].tolist(), strict=True)))
    want = Counter()
    for _, t in table:
        if found := tool.document(t or ""):
            want.update(found[5].tolist())
    for a in vector.nonzero()[0].tolist():
        counts[a * tool.n_b + int(tool.same[a])] += int(vector[a])
    assert counts == want


def test_stretches_align_as_the_whole(monkeypatch):
    tool = align.Aligner(*PATHS)
    text = "  ".join([words(1, 300), "x\n\ny é", words(2, 300)])
    whole = tool.document(text)
    monkeypatch.setattr(align, "spans", lambda t: units.spans(t, 64))
    cut = tool.document(text)
    assert whole[:5] == cut[:5] and whole[5].tolist() == cut[5].tolist() and whole[6].tolist() == cut[6].tolist()


def test_empty_table(spark):
    assert align.align(docs(spark, []), *PATHS).collect() == []
    assert got(align.align(docs(spark, [(1, None), (None, "")]), *PATHS)) == Counter([(1, *ZERO), (None, *ZERO)])


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_given_table(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    assert got(align.align(table, *PATHS)) == plain([(r["doc_id"], r["text"]) for r in table.collect()])
