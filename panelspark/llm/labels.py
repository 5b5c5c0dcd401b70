"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int, seed: int = 0, where=None) -> DataFrame:
    """(doc_id, text, y): a document of each of at most ``most`` labelled ids, the same ones in every run.

    labels has doc_id and the 0/1 column ``target``; rows where either is null
    are left out. ``where`` is a condition on doc_id. The ids with the smallest
    hashes are taken, so the sample depends on neither order nor partitions; of
    an id's rows, that with the smallest hash of the text, so rows are bounded too.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).dropna()
    if where is not None:
        own = own.filter(where)
    # A majority stands for labels that contradict each other.
    own = own.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    few = own.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
    return own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text", "y")).alias("x")).select("doc_id", "x.text", "x.y")
