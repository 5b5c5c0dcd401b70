"""Packing documents into sequences of a fixed length, shortest pack first over the histogram of lengths.

Documents are tokenised and cut into pieces of the sequence length; what is
left of each is packed. Only the histogram of those lengths reaches the
driver, one number for each length. There whole groups of like packs are
filled at once, longest lengths first, each going to the packs with most room:
a group is a packing pattern with its count, and placing a length moves packs
from one pattern to another. A length that fits nowhere opens packs as long as
the shorter lengths can still fill all room; after that it is cut to fill the
roomiest packs, and its rest counts as a shorter length. So all sequences but
one are full.

Each placing is a range of ranks among the pieces of a length that lies on a
range of sequences, so pieces find theirs by rank. Ranks are counted within
blocks of pieces, and blocks of a length are numbered by running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts, saved, text_of
from panelspark.llm.units import ByteLevel, raw, spans

SIZE = 1024
END = 0
#: Pieces of a block; blocks of a task have numbers of their own.
BLOCK, BLOCKS = 1 << 12, 1 << 20
#: Ids go through pandas as text: a column of numbers with nulls would become floating.
PIECES = "block long, place int, rank int, doc_id string, start long, length int, doc_tokens long, ids binary"
PLACED = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@cache
def _tokenizer(path: str) -> ByteLevel:
    return ByteLevel(path, special=True)


def document_ids(text: str, path: str, end: int = END) -> bytes:
    """The ids of a text and the end, as little-endian unsigned 32-bit numbers."""
    return b"".join([raw(_tokenizer(path).encode(s)) for s in spans(text)]) + raw([end])


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of at most ``size`` ids with their place in a block and their rank among its pieces of that length.

    docs has doc_id and text, other columns are ignored. Null and empty texts
    have the end only; repeated rows are documents of their own; a null doc_id
    stays null; very long texts are tokenised in stretches; an empty table
    gives none. ``path`` is a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, ranks = TaskContext.get().partitionId(), 0, np.zeros(size + 1, dtype=np.int64)
        names, held, weight = [x.split()[0] for x in PIECES.split(", ")], [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = document_ids(text, path, end)
                total = len(ids) // 4
                for start in range(0, total, size):
                    if n % BLOCK == 0:
                        ranks[:] = 0
                    own = ids[4 * start : 4 * (start + size)]
                    held.append((task * BLOCKS + n // BLOCK, n % BLOCK, ranks[len(own) // 4], doc, start, len(own) // 4, total, own))
                    ranks[len(own) // 4] += 1
                    n, weight = n + 1, weight + len(own)
                    if weight > 1 << 23:
                        yield pd.DataFrame(held, columns=names)
                        held, weight = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)
                held, weight = [], 0

    return map_texts(docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of().alias("text")), run, PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Placings, and the number of sequences.

    A placing (length, rank, count, sequence, offset, cut, next_rank): pieces
    of that length and of ``count`` ranks from ``rank`` on lie on as many
    sequences from ``sequence`` on, each at ``offset``. Where cut is less than
    the length, only so many ids do, and the rests are pieces of their own
    length with ranks from ``next_rank`` on.
    """
    counts = [0] * (size + 1)
    for length, n in histogram.items():
        counts[length] = n
    unplaced = sum(length * n for length, n in enumerate(counts))
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free ids: patterns as (first sequence, count)
    free, opened, out = 0, 0, []
    for length in range(size, 0, -1):
        rank, left, most = 0, counts[length], size
        while left:
            # Placing only ever takes room away, so the search goes on from where it was; new packs have it begin again.
            while most and not room[most]:
                most -= 1
            if most < length and (fresh := min(left, (unplaced - free) // size) if most else left):
                if not most:
                    fresh = min(left, max(1, unplaced // size))
                room[size].append((opened, fresh))
                opened, free, most = opened + fresh, free + fresh * size, size
            first, packs = room[most].pop()
            take, cut = min(left, packs), min(length, most)
            if take < packs:
                room[most].append((first + take, packs - take))
            if cut < most:
                room[most - cut].append((first, take))
            rest = length - cut
            out.append((length, rank, take, first, size - most, cut, counts[rest] if rest else 0))
            if rest:
                counts[rest] += take
            rank, left, free, unplaced = rank + take, left - take, free - take * cut, unplaced - take * cut
    return out, opened


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) from pieces as of :func:`pieces`.

    Each piece lies at ``offset`` of its sequence; pieces of a sequence follow
    each other without a gap. Pieces of full length are sequences of their own,
    with numbers after those of the others, not each number in use.
    """
    cut = saved(cut, "pack-pieces")
    short = cut.filter(F.col("length") < size)
    counts = saved(short.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placings, sequences = plan(histogram, size)
    table = np.array(placings, dtype=np.int64).reshape(-1, 7)
    keys = table[:, 0] << 48 | table[:, 1]
    order = np.argsort(keys)
    keys, table = keys[order], table[order]
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, length, rank, at = np.arange(len(pdf)), pdf["length"].to_numpy("int64"), pdf["rank"].to_numpy("int64"), np.zeros(len(pdf), dtype=np.int64)
            found = []
            while len(row):
                hit = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
                step = rank - hit[:, 1]
                found.append(np.stack([row, at, hit[:, 5], hit[:, 3] + step, hit[:, 4]], axis=1))
                on = hit[:, 5] < length
                row, at, length, rank = row[on], (at + hit[:, 5])[on], (length - hit[:, 5])[on], (hit[:, 6] + step)[on]
            row, at, length, sequence, offset = np.concatenate(found).T
            some, ids = pdf.iloc[row], pdf["ids"].array
            yield pd.DataFrame({"doc_id": some["doc_id"].array, "start": some["start"].to_numpy("int64") + at, "length": length, "ids": [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row, at, length, strict=True)],
                                "doc_tokens": some["doc_tokens"].array, "sequence_id": sequence, "offset": offset})

    own = short.join(bases, ["block", "length"]).select("doc_id", "start", "length", (F.col("base") + F.col("rank")).alias("rank"), "doc_tokens", "ids")
    whole = cut.filter(F.col("length") == size).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (F.col("block") * BLOCK + F.col("place") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return map_texts(own, find, PLACED).unionByName(whole).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequences and offsets: :func:`pieces`, then :func:`place`."""
    return place(pieces(docs, path, size, end), size)
