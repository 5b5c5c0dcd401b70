"""Alignment of the tokens of two tokenizers over a corpus.

Tokens of A and B over the same bytes are cut into groups where both end. Most
groups hold one token of each with the same bytes. Such pairs are known before
any text is read, as an array from A's ids to B's; each task counts the
documents that hold them in a vector as long as the vocabulary. Only other
pairs, those of irregular groups, enter a shuffle, and they are first counted
within blocks of documents. So a pair has a row for each block, however many
documents hold it. Its count goes back to the blocks, where the documents
still have their links as places in the block's list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts, saved, text_of
from panelspark.llm.units import ByteLevel, spans

#: Bytes of text and documents of a block; blocks of a task have numbers of their own.
BLOCK_BYTES, BLOCK_DOCS, BLOCKS = 4 << 20, 1 << 12, 1 << 20
#: Pairs of a block in one row.
LOT = 1 << 13
DOCUMENT, PAIRS, VECTOR = 0, 1, 2
#: Ids go through pandas as text: a column of numbers with nulls would become floating.
COUNTS = "n_a long, n_b long, n_groups long, n_links long"
BLOCKED = f"kind int, block long, doc_id string, {COUNTS}, groups string, same binary, same_n binary, odd binary, odd_n binary, at int, pairs array<long>, docs array<long>"
ALIGNED = f"doc_id string, {COUNTS}, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Both tokenizers with the bytes of their ids, and the array from A's ids to the B-ids of the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteLevel(path_a, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        #: Where a piece has a space after another character, texts are not cut.
        self.whole = any("▁" in x.lstrip("▁") for x in pieces)
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        plain = {x: i for i, x in enumerate(self.bytes_b) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([plain.get(x, -1) for x in self.a.bytes])
        self.len_a, self.len_b = (np.array([len(x) for x in v]) for v in (self.a.bytes, self.bytes_b))
        self.n_a, self.n_b = len(self.a.bytes), n_b
        names = [str(i) for i in range(max(self.n_a, n_b))]
        self._comma, self._bar, self._end = (np.array([x + y for x in names], dtype=object) for y in ",|;")

    def span(self, text: str) -> tuple | None:
        """Of a stretch that begins with a space: tokens of A and B, groups, links as codes (A's id times the size of B, plus B's id), and the groups as text. None where bytes differ."""
        a, b = self.a.encode(text), self.b.encode(text[1:], num_threads=1)
        want = text.encode()
        if b"".join([self.a.bytes[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.zeros(len(want) + 1, dtype=np.int8)
        ends[end_a] = 1
        ends[end_b] += 2
        at = np.flatnonzero(ends)
        kind = ends[at]
        # Each stretch between two ends lies in one token of A and one of B: a link.
        is_a, is_b, both = (kind & 1).astype(np.int64), kind >> 1, kind == 3
        link_a, link_b = np.cumsum(is_a) - is_a, np.cumsum(is_b, dtype=np.int64) - is_b
        codes = a[link_a] * self.n_b + b[link_b]
        group = np.cumsum(both) - both
        group_a, group_b = group[is_a == 1], group[is_b == 1]
        n_groups = int(both.sum())
        # A group's text is its A tokens, then its B tokens.
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
        up_to_a = np.cumsum(np.bincount(group_a, minlength=n_groups))
        out = np.empty(len(a) + len(b), dtype=object)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        out[np.arange(len(a)) + before_b[group_a]] = np.where(last_a, self._bar[a], self._comma[a])
        out[np.arange(len(b)) + up_to_a[group_b]] = np.where(last_b, self._end[b], self._comma[b])
        return len(a), len(b), n_groups, codes, "".join(out.tolist())

    def document(self, text: str) -> tuple | None:
        """(n_a, n_b, n_groups, n_links, digest of the groups, codes, times of each code); None without tokens."""
        if not text:
            return None
        digest, sums, held = sha256(), np.zeros(4, dtype=np.int64), []
        stretches = [" " + text] if self.whole else spans(" " + text)
        for no, s in enumerate(stretches):
            found = self.span(s)
            if found is None:
                return None
            n_a, n_b, n_groups, codes, groups = found
            digest.update((";" * (no > 0) + groups[:-1]).encode())
            sums += (n_a, n_b, n_groups, len(codes))
            held.append(np.unique(codes, return_counts=True))
        codes, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)
        return (*sums.tolist(), digest.hexdigest(), codes, times)


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _u32(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _read(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<u4").astype(np.int64)


class _Block:
    """Documents of a block until their pairs are counted."""

    def __init__(self, size_b: int, same: np.ndarray):
        self.rows, self.odd, self.weight, self._size_b, self._same = [], [], 0, size_b, same

    def add(self, doc, text: str, found: tuple | None, vector: np.ndarray) -> None:
        self.weight += len(text)
        if found is None:
            self.rows.append((doc, 0, 0, 0, 0, "", b"", b"", b""))
            self.odd.append(np.zeros(0, dtype=np.int64))
            return
        *sums, digest, codes, times = found
        ids = codes // self._size_b
        same = self._same[ids] == codes % self._size_b
        vector[ids[same]] += 1
        self.rows.append((doc, *sums, digest, _u32(ids[same]), _u32(times[same]), _u32(times[~same])))
        self.odd.append(codes[~same])

    @property
    def full(self) -> bool:
        return self.weight >= BLOCK_BYTES or len(self.rows) >= BLOCK_DOCS

    def frames(self, block: int) -> Iterator[pd.DataFrame]:
        codes, place, docs = np.unique(np.concatenate(self.odd), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) for x in self.odd])
        odd = [_u32(x) for x in np.split(place, ends[:-1])]
        out = pd.DataFrame(self.rows, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "same", "same_n", "odd_n"])
        yield _filled(out.assign(kind=DOCUMENT, block=block, odd=odd))
        for at in range(0, len(codes), LOT):
            yield _filled(pd.DataFrame({"kind": [PAIRS], "block": block, "at": at, "pairs": [codes[at : at + LOT]], "docs": [docs[at : at + LOT]]}))


def _filled(part: pd.DataFrame) -> pd.DataFrame:
    """All columns of BLOCKED; those that a kind of rows lacks are empty."""
    empty = {"block": -1, "doc_id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": None, "same": None, "same_n": None, "odd": None, "odd_n": None, "at": 0, "pairs": None, "docs": None}
    return part.assign(**{k: v for k, v in empty.items() if k not in part})[[x.split()[0] for x in BLOCKED.split(", ")]]


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents in blocks with their links, each block's irregular pairs with the number of its documents that hold them, and each task's vector of the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = _aligner(path_a, path_b)
        vector, task, n, own = np.zeros(tool.n_a, dtype=np.int64), TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = own or _Block(tool.n_b, tool.same)
                own.add(doc, text, tool.document(text), vector)
                if own.full:
                    yield from own.frames(task * BLOCKS + n)
                    n, own = n + 1, None
        if own:
            yield from own.frames(task * BLOCKS + n)
        ids = np.flatnonzero(vector)
        if len(ids):
            yield _filled(pd.DataFrame({"kind": [VECTOR], "pairs": [ids], "docs": [vector[ids]]}))

    return map_texts(docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of().alias("text")), run, BLOCKED)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each row of docs.

    A encodes a space and the text, B the text, to which it adds the space
    itself; strings of special tokens are plain text. Null and empty texts and
    those that either tokenizer doesn't give back byte for byte have no tokens:
    zeros, and no digest. docs has doc_id and text, other columns are ignored;
    repeated rows are documents of their own; a null doc_id stays null; very
    long texts are aligned in stretches; an empty table gives none. Ties for an
    A id's highest count all count as best. The files must be open to every
    executor. Two arrays as long as A's vocabulary pass the driver.
    """
    own = saved(blocks(docs, path_a, path_b), "align-blocks")
    tool = _aligner(path_a, path_b)
    n_a, n_b, same = tool.n_a, tool.n_b, tool.same
    sums = own.filter(F.col("kind") == VECTOR).select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("a")).agg(F.sum("x.docs").alias("n")).collect()
    fast = np.zeros(n_a, dtype=np.int64)
    for r in sums:
        fast[r["a"]] = r["n"]
    pairs = own.filter(F.col("kind") == PAIRS).select("block", "at", F.posexplode(F.arrays_zip("pairs", "docs")).alias("no", "x"))
    pairs = pairs.select("block", (F.col("at") + F.col("no")).alias("no"), F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counted = saved(pairs.select("block", "no", "pair", F.sum("docs").over(Window.partitionBy("pair")).alias("n")), "align-counts")
    best = fast.copy()
    for r in counted.groupBy(F.floor(F.col("pair") / n_b).cast("int").alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts, highest = np.zeros(len(right), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
        counts[right["no"]] = right["n"]
        highest[right["no"]] = best[right["pair"].to_numpy("int64") // n_b]
        n_best, total = [], []
        for ids, times, places, odd_times in zip(*(map(_read, left[c]) for c in ("same", "same_n", "odd", "odd_n")), strict=True):
            n_best.append(times[fast[ids] == best[ids]].sum() + odd_times[counts[places] == highest[places]].sum())
            total.append((times * fast[ids]).sum() + (odd_times * counts[places]).sum())
        return left[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].assign(n_best=n_best, count_sum=total, groups_sha256=left["groups"])

    rows = own.filter(F.col("kind") == DOCUMENT).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "same", "same_n", "odd", "odd_n")
    out = rows.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(score, ALIGNED)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
