"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. The whole part of target over
source size is given to each of its documents as certain copies. What is left
is a sample of fixed size: documents are ranked by random odds over inclusion
odds (Rosén's Pareto sampling) and taken in that order until the rest of the
target is met. No document is cut, so the rest is met to within half of the
document at the boundary.

Inclusion odds are those of probabilities proportional to the square root of a
document's size, at most one, and such that the words expected are the rest of
the target. A source's factor of proportion follows from its distinct sizes.

The boundary is found without gathering a source anywhere: histograms of the
rank in ``LEVELS`` rounds of ``BUCKETS`` buckets, summed before they are
shuffled, narrow it down to a sliver of the ranks. Rows of a sliver that agree
in all that ranks them are counted, and only their distinct kinds are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, broadcast_if, saved, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17
BUCKETS = 256
LEVELS = 2
#: Like rows that are given back together.
LOT = 10_000
#: Plans of sources with more rows than this are joined by a shuffle.
MAX_BROADCAST_SOURCES = 20_000


def source_plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, docs, target, whole, rest, part): one row for each source.

    ``sizes`` has source and size. Sources in code point order, null last, get
    the weights in turn and share ``share`` of all words; a target stops at
    ``cap`` times its source, the excess going to the others by weight. That
    fixed point is a water level: with sources sorted by the level at which
    they fill up, the level is the largest one that fits below its own source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_pos", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_pos") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap).withColumn("_fill", F.col("_cap") / F.col("_w"))
    by_fill = Window.orderBy("_fill", "_pos")
    before = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_budget", F.sum("source_size").over(everything) * share)
    per = per.withColumn("_level", (F.col("_budget") - before) / still)
    level = F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(everything)
    per = per.withColumn("target", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("whole", whole)
    per = per.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    part = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "docs", "target", "whole", "rest", part.alias("part"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on nothing but the id and the seed: 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def inclusion_factors(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, factor): a document is included with probability min(1, factor * sqrt(size)), so that the rest of the target is expected.

    The larger documents are certain: with t as the largest size that isn't,
    the factor shares what they leave among the others. Of all t, the first
    from above whose own probability is at most one is right.
    """
    per = sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n"))
    part = plan.filter("part > 0").select(F.col("source").alias("_s"), "rest")
    per = per.join(part, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    above = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    certain = F.coalesce(F.sum(F.col("_n") * F.col("size")).over(above), F.lit(0))
    spread = F.sum(F.col("_n") * F.col("size") * F.sqrt("size")).over(up_to)
    per = per.withColumn("_f", (F.col("rest") - certain) / spread).filter(F.col("_f") * F.sqrt("size") <= 1)
    return per.groupBy("source").agg(F.max_by("_f", "size").alias("factor"))


def pareto_rank() -> Column:
    """Random odds over inclusion odds, mapped to (0, 1) with the order kept; 0 where inclusion is certain."""
    u, p = F.col("_u"), F.coalesce(F.col("factor"), F.lit(0.0)) * F.sqrt("size")
    chance = F.greatest(p, F.lit(1e-12))
    odds = (u / (1 - u)) / (chance / (1 - chance))
    return F.when(p >= 1, 0.0).otherwise(odds / (1 + odds))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row for each row of docs.

    ``docs`` has doc_id, text and source; other columns are ignored. A null
    text or one without words has size 0 and takes 0. A null source is a
    source of its own, after the others. Repeated rows are documents of their
    own that rank alike, one after the other. A null doc_id ranks as the empty
    id. An empty table gives an empty result. Targets are planned by windows over
    one row for each source, which so must fit one task.
    """
    sizes = saved(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")),
        "mix-sizes",
    )
    plan = saved(source_plan(sizes, weights, share, cap), "mix-plan")
    n_sources = plan.count()
    other = plan.withColumnRenamed("source", "_s")
    other = other.join(inclusion_factors(sizes, plan), F.col("_s").eqNullSafe(F.col("source")), "left").drop("source")
    rows = sizes.join(broadcast_if(other, n_sources, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sampled = (F.col("size") > 0) & (F.col("part") > 0)
    rows = rows.withColumn("_u", uniform(F.col("doc_id"), seed)).withColumn("_rank", F.when(sampled, pareto_rank())).drop("_u")
    rows = saved(rows, "mix-ranks")

    #: The sliver of ranks that holds a source's boundary: [_low, _low + _width), and the words before it.
    cut = plan.filter("part > 0").select(F.col("source").alias("_s"), "rest", F.lit(0.0).alias("_low"), F.lit(1.0).alias("_width"), F.lit(0).cast("long").alias("_before"))
    small = n_sources <= MAX_BROADCAST_SOURCES
    for level in range(LEVELS):
        at = rows.select("source", "size", "_rank").filter("_rank is not null").join(F.broadcast(cut) if small else cut, F.col("source").eqNullSafe(F.col("_s")))
        bucket = F.floor((F.col("_rank") - F.col("_low")) / F.col("_width") * BUCKETS).cast("int")
        counts = at.withColumn("_b", bucket).filter(F.col("_b").between(0, BUCKETS - 1)).groupBy("_s", "rest", "_low", "_width", "_before", "_b").agg(F.sum("size").alias("_n"))
        w = Window.partitionBy("_s").orderBy("_b")
        counts = counts.withColumn("_cum", F.col("_before") + F.sum("_n").over(w)).withColumn("_prior", F.col("_cum") - F.col("_n"))
        last = F.lead("_b").over(w).isNull()
        counts = counts.withColumn("_last", last).filter(((F.col("_cum") >= F.col("rest")) & (F.col("_prior") < F.col("rest"))) | (F.col("_last") & (F.col("_cum") < F.col("rest"))))
        cut = saved(
            counts.select("_s", "rest", (F.col("_low") + F.col("_b") * F.col("_width") / BUCKETS).alias("_low"), (F.col("_width") / BUCKETS).alias("_width"), F.col("_prior").alias("_before")),
            f"mix-cut{level}",
        )
    marked = rows.join(F.broadcast(cut.drop("rest")) if small else cut.drop("rest"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    inside = F.coalesce((F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_low") + F.col("_width")), F.lit(False))
    clear = marked.filter(~inside).withColumn("_extra", F.coalesce(F.col("_rank") < F.col("_low"), F.lit(False)))
    # Rows of one rank, id and size are alike: so many of them are taken, whichever. Only kinds are sorted.
    kinds = marked.filter(inside).groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_n")).over(w), F.lit(0))
    fits = F.floor((F.col("rest") - F.col("_prior")) / F.col("size") + 0.5)
    kinds = kinds.withColumn("_prior", prior).withColumn("_taken", F.least(F.greatest(fits, F.lit(0)), F.col("_n")))
    each = F.array(F.struct(F.lit(True).alias("x"), F.col("_taken").alias("n")), F.struct(F.lit(False).alias("x"), (F.col("_n") - F.col("_taken")).alias("n")))
    kinds = kinds.withColumn("_e", F.explode(each)).filter("_e.n > 0").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_e.n") - 1) / LOT))))
    # Rows come back in lots, dealt out to many tasks.
    lots = kinds.repartition("source", "doc_id", "size", "_lot").withColumn("_in_lot", F.least(F.col("_e.n") - F.col("_lot") * LOT, F.lit(LOT)))
    sliver = lots.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_in_lot")))).withColumn("_extra", F.col("_e.x")).select(*clear.columns)
    both = clear.unionByName(sliver)
    copies = F.col("whole") + F.col("_extra").cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: DuckDB's form of :func:`mix` with the default parameters, without the histograms.
ORACLE = """
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM s GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM per),
levels AS (SELECT *, ((SELECT sum(source_size) FROM per) * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aims AS (SELECT source, source_size, docs, least(source_size * 2.0::DOUBLE, (SELECT max(level) FROM levels WHERE level <= source_size * 2.0::DOUBLE / w) * w) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aims),
rests AS (SELECT *, greatest(target - whole * source_size, 0) AS rest, CASE WHEN source_size > 0 THEN greatest(target - whole * source_size, 0) / source_size ELSE 0 END AS part FROM plan),
kinds AS (SELECT s.source, s.size, count(*) AS n, any_value(r.rest) AS rest FROM s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE s.size > 0 AND r.part > 0 GROUP BY s.source, s.size),
tries AS (SELECT source, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(n * size * sqrt(size::DOUBLE)) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS f FROM kinds),
factors AS (SELECT source, arg_max(f, size) AS factor FROM tries WHERE f * sqrt(size::DOUBLE) <= 1 GROUP BY source),
chances AS (SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.whole, r.rest, r.part,
    (CAST('0x' || substr(md5('17:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    coalesce(f.factor, 0.0::DOUBLE) * sqrt(s.size::DOUBLE) AS p
  FROM s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN factors f ON s.source IS NOT DISTINCT FROM f.source),
ranked AS (SELECT *, CASE WHEN size > 0 AND part > 0 THEN CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (greatest(p, 1e-12::DOUBLE) / (1 - greatest(p, 1e-12::DOUBLE))) END END AS q FROM chances),
summed AS (SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM ranked)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN q IS NOT NULL AND cum - rest <= rest - (cum - size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM summed
"""


def repeat(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs, with the same columns, each row as often as :func:`mix` takes it: 0, 1 or 2 times by default.

    Rows are told apart by id, source and a hash of the text. Where rows agree
    in all of these, they share out the copies of them all. A null id, text or
    source is a value like others; an empty table gives an empty one.
    """
    own = docs.withColumn("_row_hash", F.xxhash64(text_of()))
    keyed = own.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "_row_hash")
    taken = mix(keyed.select(F.struct("doc_id", "_row_hash").alias("doc_id"), "text", "source"), weights, share, cap, seed)
    times = saved(
        taken.filter("copies > 0").groupBy(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._row_hash").alias("_hash"), F.col("source").alias("_source")).agg(F.sum("copies").cast("int").alias("_times"), F.count(F.lit(1)).alias("_rows")),
        "mix-times",
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash")) & F.col("source").cast("string").eqNullSafe(F.col("_source"))
    if docs.groupBy("doc_id", "source", F.xxhash64(text_of())).count().filter("count > 1").take(1):
        own = own.dropDuplicates(["doc_id", "source", "_row_hash"])
    return own.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
