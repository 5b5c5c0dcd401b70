"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a point within r/2 of both. So each
distinct fingerprint emits all points within half the radius, the points are
shuffled, and fingerprints that meet at one are verified and linked. Distinct
fingerprints that meet at a point are at most as many as the ball has points
(65 for radius 2), whatever the data; they are linked in a chain, each to the
next, not in pairs. Components of the links follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from panelspark.llm.common import map_texts, saved, text_of
from panelspark.llm.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
_CHUNK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, as a signed 64-bit number; 0 without words."""
    # Bytes split and lower-case in ASCII only.
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(t) for t in zip(*[words[i:] for i in range(shingle)], strict=False)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(parts), _CHUNK):
        raw = b"".join([xxh64_digest(p, SEED) for p in parts[at : at + _CHUNK]])
        counts += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts)).view(">i8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "row_hash": pdf["row_hash"], "fp": np.array([fingerprint(t) for t in pdf["text"]], dtype=np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, fp): a row for each row; row_hash tells texts of one id apart."""
    text = text_of()
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text")), _fingerprints, "doc_id long, row_hash long, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints fp, enough of them to connect all within the radius."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: both sides of a link walk half of it")
    masks = [0] + [sum(1 << i for i in bits) for n in range(1, radius // 2 + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    ball = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in signed]))
    meet = Window.partitionBy("point").orderBy("fp")
    met = fps.select("fp", ball.alias("point")).select("fp", F.lag("fp").over(meet).alias("other")).filter("other is not null")
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def classes(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows as of :func:`fingerprints`; nodes (fp, label, first_id).

    label is the smallest fingerprint of the component, first_id the smallest
    doc_id in the component.
    """
    fps = saved(fingerprints(docs), "simhash-rows")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    found = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    nodes = saved(distinct.join(found, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first_id"), "simhash-labels")
    first = nodes.groupBy("label").agg(F.min("first_id").alias("first_id"))
    return fps, saved(nodes.drop("first_id").join(first, "label").select("fp", "label", "first_id"), "simhash-nodes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of docs, repeated ones too.

    docs has doc_id and text; other columns are ignored. A null text counts as
    empty; texts without words have fingerprint zero and link like others. A
    null doc_id stays null and is never a component_id unless a component has
    no other. An empty table gives an empty result.
    """
    fps, nodes = classes(docs, radius)
    return fps.join(nodes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first_id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs, with the same columns, with one row of each component: that of the smallest doc_id.

    Null ids come last; among rows of one id, that of the smallest text hash
    stays, and of identical rows one. A null text counts as empty; an empty
    table gives an empty one.
    """
    fps, nodes = classes(docs, radius)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("best")
    kept = saved(fps.join(nodes, "fp").groupBy("label").agg(best).select(F.col("best.doc_id").alias("_kept_id"), F.col("best.row_hash").alias("_kept_hash")), "simhash-kept")
    own = docs.withColumn("_row_hash", F.xxhash64(text_of()))
    out = own.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_row_hash") == F.col("_kept_hash")), "left_semi")
    if fps.groupBy("doc_id", "row_hash").count().filter("count > 1").take(1):
        out = out.dropDuplicates(["doc_id", "_row_hash"])
    return out.select(*docs.columns)
