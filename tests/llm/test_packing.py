import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelspark.llm import packing, queries
from panelspark.llm.units import ByteLevel, spans
from tests.llm.helpers import EDGES, docs, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 40), max_size=10))
def test_plan_fills_all_sequences_but_one(histogram):
    placings, sequences = packing.plan(histogram, 16)
    tokens = sum(length * n for length, n in histogram.items())
    assert sequences == -(-tokens // 16)
    at = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, count, sequence, offset, cut, next_rank in placings:
        ranks[length] += range(rank, rank + count)
        for k in range(count):
            at[sequence + k].append((offset, cut))
        assert cut <= length and (cut == length or next_rank >= histogram.get(length - cut, 0))
    for length, own in ranks.items():
        assert own == list(range(len(own))) and len(own) >= histogram.get(length, 0)
    for own in at.values():
        end = 0
        for offset, cut in sorted(own):
            assert offset == end
            end += cut
        assert end <= 16
    assert sum(cut for own in at.values() for _, cut in own) == tokens


def test_a_length_goes_to_the_packs_with_most_room_and_is_cut_only_where_nothing_fits():
    assert packing.plan({6: 1, 5: 1, 3: 1, 2: 1}, 8) == ([(6, 0, 1, 0, 0, 6, 0), (5, 0, 1, 1, 0, 5, 0), (3, 0, 1, 1, 5, 3, 0), (2, 0, 1, 0, 6, 2, 0)], 2)
    # Three of 6 on packs of 8: the third would leave room that nothing fills.
    assert packing.plan({6: 3, 1: 6}, 8)[1] == 3
    assert packing.plan({6: 4}, 8)[1] == 3


@pytest.mark.parametrize("seed", range(3))
def test_patterns_stay_few_whatever_the_counts(seed):
    rng = random.Random(seed)
    placings, sequences = packing.plan({n: rng.randrange(10**9) for n in range(1, 1024)})
    assert len(placings) < 20_000 and sequences > 10**8


def check(got, table, size):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in table)
    own, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= size
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    tokens = sum(len(ids) * n for (_, ids), n in want.items())
    assert len(sequences) * size - tokens < size
    # Documents of one id can't be told apart by their pieces: then all ids are compared.
    for i in {i for i, _ in table}:
        docs_of = [ids for (k, ids), n in want.items() if k == i for _ in range(n)]
        assert Counter(x for r in own[i] for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == Counter(x for ids in docs_of for x in ids)
        if len(docs_of) == 1:
            pieces = sorted(own[i], key=lambda r: r["start"])
            assert np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist() == list(docs_of[0])
            assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist() and {r["doc_tokens"] for r in pieces} == {len(docs_of[0])}


@pytest.mark.parametrize("size", [16, packing.SIZE])
def test_every_id_lies_in_one_piece_and_sequences_are_full(spark, size):
    table = [*EDGES, (2**60 + 1, "a large id"), (20, "text with <|endoftext|> in it<|endoftext|>"), *[(100 + i, words(i, 1 + i % 50)) for i in range(60)]]
    check(packing.pack(docs(spark, table).repartition(3), PATH, size).collect(), table, size)


def test_an_empty_table_and_a_third_of_rows_alike(spark):
    assert packing.pack(docs(spark, []), PATH).collect() == []
    table = [(7, "the same text again and again")] * 40 + [(i, words(i, 30)) for i in range(100, 180)]
    check(packing.pack(docs(spark, table), PATH, 32).collect(), table, 32)


def test_query_on_the_given_table(spark):
    got = queries.op12_packing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    fast = ByteLevel(PATH, special=True)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    used = Counter()
    for r in got.collect():
        raw = np.array([*fast.encode(texts[r["doc_id"]]), 0], dtype="<u4")[r["start"] : r["start"] + r["length"]].tobytes()
        assert r["ids_crc32"] == zlib.crc32(raw)
        used[r["doc_id"]] += r["length"]
    assert all(used[i] == len(fast.encode(t)) + 1 for i, t in texts.items())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'st 1\n\t .,é世🙂  <|endoftext|>", max_size=300), st.booleans(), st.integers(1, 60))
def test_stretches_have_the_ids_of_the_whole(text, special, size):
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = not special
    fast = FAST[special]
    assert "".join(spans(text, size)) == text
    assert [i for s in spans(text, size) for i in fast.encode(s)] == whole.encode(text, add_special_tokens=False).ids


FAST = {x: ByteLevel(PATH, x) for x in (False, True)}
