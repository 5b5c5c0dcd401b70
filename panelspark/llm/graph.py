"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import dropped, saved

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of links (a, b), the smallest node it can reach.

    Trees of parents that merge and flatten (the FastSV scheme): a round takes
    the smallest grandparent among a node's neighbours and offers it to the
    node and to the node's parent, then lets every node point to its own
    grandparent. So even a chain ends after about the logarithm of its length.
    Links are never rewritten, offers to a common parent are reduced before
    they are shuffled, and the join on parents is a plain inner join that Spark
    may split. Every round is written to the shared folder, and the one before
    it removed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = saved(both, "cc-links")
    state = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("f")), "cc-0")
    for step in range(1, MAX_ROUNDS):
        parents = state.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        known = saved(state.select("node", "f").join(parents, "f").select("node", "f", "gf"), f"cc-{step}a")
        near = both.join(known.select(F.col("node").alias("b"), "gf"), "b").groupBy(F.col("a").alias("node")).agg(F.min("gf").alias("m"))
        offers = near.join(known.select("node", "f"), "node").select(F.explode(F.array("node", "f")).alias("node"), "m", F.lit(None).cast("long").alias("old"))
        own = known.select("node", F.least("f", "gf").alias("m"), F.col("f").alias("old"))
        after = saved(own.unionByName(offers).groupBy("node").agg(F.min("m").alias("f"), F.max("old").alias("old")), f"cc-{step}b")
        dropped(state, known)
        state = after
        if state.filter("f <> old").limit(1).count() == 0:
            dropped(both)
            return state.select("node", F.col("f").alias("label"))
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
