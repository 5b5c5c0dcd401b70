"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Every stage takes null ids, texts and sources, repeated rows and tables without
rows, as its operator says; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, mixing, quality_rules, secret_scan, simhash
from panelspark.llm.common import clear, read, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, ids as little-endian unsigned 32-bit numbers."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scans", secrets), ("mixing", mixture), ("encoding", encoding)]

#: Trees, fingerprints and merges have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for documents: doc_id, n_tokens and digests of the ids and of the bytes decoded from them."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    import public_tokenizers

    encoded = STAGES[-1][1](spark, docs, sf_dir)
    out = bpe.decode(encoded, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes run()'s rows to path as Parquet and then removes every intermediate table from the shared folder."""
    run(spark, sf_dir).write.parquet(path)
    clear(spark)
