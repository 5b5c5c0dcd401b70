import random
import time
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelspark.llm import bpe
from tests.llm.helpers import EDGES, docs

V = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def plain(t):
    return bpe._raw(bpe._encoding(*V).encode_ordinary(t or ""))


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet="ab'st 1\n\t .,é世🙂'l  ", max_size=400), st.sampled_from([(16, 8), (20, 5), (64, 16)]))
def test_stitched_chunks_equal_the_whole(text, sizes):
    chunk, overlap = sizes
    n = max(1, -(-len(text) // chunk))
    parts = [bpe.encode_chunk(text[i * chunk : (i + 1) * chunk + overlap], i, i + 1 == n, *V, chunk, overlap) for i in range(n)]
    got = bpe.stitch(parts)
    assert got is None or got == plain(text)


def test_long_texts_are_stitched_not_given_up():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeéß'") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    n = -(-len(text) // 2000)
    assert bpe.stitch([bpe.encode_chunk(text[i * 2000 : i * 2000 + 2300], i, i + 1 == n, *V, 2000, 300) for i in range(n)]) == plain(text)


@pytest.mark.parametrize("sizes", [(1000, 100), (bpe.CHUNK, bpe.OVERLAP)])
def test_round_trip_of_a_table(spark, sizes):
    table = [*EDGES, (60, " " * 5000), (61, "y" * 5000), (62, "ab cd " * 800), (62, "ab cd " * 800)]
    got = bpe.decode(bpe.encode(docs(spark, table), *V, *sizes), *V).collect()
    have = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got)
    assert have == Counter((i, len(plain(t)) // 4, plain(t), (t or "").encode()) for i, t in table)
    assert bpe.encode(docs(spark, []), *V).collect() == []


def test_many_copies_of_one_long_text_under_null_and_other_ids(spark):
    text = "so many copies of one text " * 60
    table = [(None, text)] * 40 + [(7, text)] * 40 + [(8, text + "!")]
    got = bpe.encode(docs(spark, table), *V, 400, 50).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, plain(t)) for i, t in table)


def test_a_very_long_text_takes_time_in_proportion(spark):
    """20 million characters in 610 chunks; a scan of the text for each chunk would take minutes."""
    base = " ".join(f"w{i % 977}é" for i in range(20_000))
    text = base * (20_000_000 // len(base))
    began = time.time()
    r = bpe.encode(docs(spark, [(1, text)]), *V).first()
    assert r["n_tokens"] > 5_000_000 and time.time() - began < 90
    head = plain(text[:100_000])
    assert bytes(r["ids"])[: len(head) - 400] == head[:-400]


def test_texts_without_a_common_boundary_are_encoded_whole(spark):
    """One word longer than any overlap can't be stitched; a third of the rows hold it, under one id."""
    word = "y" * 3000
    table = [(7, word)] * 20 + [(i, f"{word} {i} and more words " * 3) for i in range(5)] + [(100 + i, "short") for i in range(30)]
    got = bpe.encode(docs(spark, table), *V, 1000, 100).collect()
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in got) == Counter((i, len(plain(t)) // 4, plain(t)) for i, t in table)


def test_bad_sizes():
    with pytest.raises(ValueError):
        bpe.encode(None, *V, 10, 8)
