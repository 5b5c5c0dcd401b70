"""Byte-level BPE encoding and decoding by overlapping chunks.

A short text is one chunk. A long one is cut into chunks that overlap, and the
chunks become rows of their own, so that one document does not hold up a task.
Each chunk is pre-tokenised by itself. Where the pre-token boundaries of a
chunk and of the one before it first agree inside the overlap, they agree from
there on, as what matches from a place depends only on what follows; there the
two are stitched. Pieces between such places are encoded separately. Without
any agreement (one pre-token longer than the overlap) the document is encoded
in one go.

Stitches are made only after a character that is no white space: then cutting
the text there changes no match before it.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts, saved, text_of

CHUNK = 32_768
OVERLAP = 1_024
#: Chunks of a text that leave the cutting task together.
AT_ONCE = 128
ENCODED = "doc_id long, n_tokens long, ids binary"


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _pieces(path: str, pattern: str) -> list[bytes]:
    enc = _encoding(path, pattern)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


@cache
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def _raw(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _safe_points(text: str, pattern: str, start: int, last: bool) -> list[int]:
    """Ends of pre-tokens that are followed by text and preceded by no white space; start itself where a document begins."""
    ends = [m.end() for m in _splitter(pattern).finditer(text)]
    if not last and ends:
        ends.pop()  # the chunk's end may have cut it
    return [start] * (start == 0) + [start + e for e in ends if not text[e - 1].isspace()]


def encode_chunk(text: str, no: int, last: bool, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> dict:
    """Safe points in the two overlaps of a chunk, and the ids of the pieces between all points kept."""
    start = no * chunk
    points = _safe_points(text, pattern, start, last)
    head = points[: bisect_left(points, start + overlap)]
    tail = [] if last else points[max(len(head), bisect_left(points, start + chunk)) :]
    cuts = head + tail + ([start + len(text)] if last else [])
    enc = _encoding(path, pattern)
    ids = [_raw(enc.encode_ordinary(text[a - start : b - start])) for a, b in zip(cuts, cuts[1:], strict=False)]
    return {"cuts": cuts, "ids": ids, "n_head": len(head)}


def stitch(chunks: list[dict]) -> bytes | None:
    """The ids of a document from its chunks in order; None where two neighbours share no safe point."""
    out, at = [], 0
    for no, c in enumerate(chunks):
        cuts = list(c["cuts"])
        if no + 1 == len(chunks):
            end = len(cuts) - 1
        else:
            common = set(cuts).intersection(list(chunks[no + 1]["cuts"])[: chunks[no + 1]["n_head"]])
            if not common:
                return None
            end = cuts.index(min(common))
        if not cuts or at not in cuts[: end + 1]:
            return None
        out += list(c["ids"])[cuts.index(at) : end]
        at = cuts[end]
    return b"".join(out)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit numbers.

    A row for each row of docs, repeated ones too; docs has doc_id and text,
    other columns are ignored. Null and empty texts have no ids; a null doc_id
    stays null; an empty table gives an empty result. ``path`` is a rank file that every executor can open.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("chunks must be at least twice as long as the overlap")

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, pattern)
        for pdf in batches:
            ids = [enc.encode_ordinary(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(x) for x in ids], "ids": [_raw(x) for x in ids]})

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [encode_chunk(t, n, last, path, pattern, chunk, overlap) for t, n, last in zip(pdf["part"], pdf["no"], pdf["no"] + 1 == pdf["parts"], strict=True)]
            yield pd.concat([pdf[["key", "no"]].reset_index(drop=True), pd.DataFrame(found, columns=["cuts", "ids", "n_head"])], axis=1)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        ids = stitch(pdf[["cuts", "ids", "n_head"]].to_dict("records"))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "ids": [ids]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "ids": [_raw(_encoding(path, pattern).encode_ordinary(t)) for t in pdf["text"]]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                parts = -(-len(text) // chunk)
                for a in range(0, parts, AT_ONCE):
                    own = range(a, min(a + AT_ONCE, parts))
                    yield pd.DataFrame({"key": key, "no": pd.Series(own, dtype="int32"), "parts": parts, "part": [text[n * chunk : (n + 1) * chunk + overlap] for n in own]})

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    is_long = F.length("text") > chunk
    few = map_texts(df.filter(~is_long), short, ENCODED)
    # Each distinct long text is encoded once, so its copies never meet in a group; the join gives them their ids.
    keyed = df.filter(is_long).withColumn("key", F.sha2("text", 256))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    fields = "key string, no int, parts int, part string"
    # Dealt out by chunk, not by document, so that a long document is encoded by many tasks.
    chunks = map_texts(map_texts(texts, cut, fields).repartition("key", "no"), chunked, "key string, no int, cuts array<long>, ids array<binary>, n_head int")
    # Texts stay out of the groups; only those that couldn't be stitched are looked up again.
    stitched = saved(chunks.groupBy("key").applyInPandas(joined, "key string, ids binary"), "bpe-stitched")
    again = map_texts(texts.join(stitched.filter("ids is null").select("key"), "key"), whole, "key string, ids binary")
    many = stitched.filter("ids is not null").unionByName(again).select("key", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")
    return few.unionByName(keyed.select("doc_id", "key").join(many, "key").drop("key"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded plus ``decoded``: the raw bytes of its ids, joined. Null ids count as none; other columns, null ones too, stay; no rows give none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(path, pattern)
        for pdf in batches:
            yield pdf.assign(decoded=[b"".join([pieces[i] for i in np.frombuffer(x or b"", dtype="<u4").tolist()]) for x in pdf["ids"]])

    return map_texts(encoded, run, schema)
