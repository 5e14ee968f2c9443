"""Mixing sources to target weights.

Tokens are counted per source; targets follow the weights, no source may repeat
more than ``most`` times, and what a capped source leaves goes to the others by
weight.  A document is then taken floor(rate) times, and once more with
probability equal to the fraction, by a hash of its id.  Built of DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.columns import WORD, hash_rate, require
from marginalia.scratch import materialize

#: Rows of a per-source table that may be broadcast; above it, the join is by shuffle.
SMALL = 20_000


def targets(per_source: DataFrame, weights: list[int], most: int) -> DataFrame:
    """source, source_size, target of a table (source, source_size).

    Sources stand by code point, null last, and weigh ``weights`` in turn.  The
    whole size of all is shared by weight; who would exceed ``most`` times its
    size is held there and the excess shared again among the rest, until none is
    above.  That end is found at once: ordered by cap over weight, the held
    sources are a prefix, and one level times the weight is the rest's target.
    The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    caps = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    load = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = caps.withColumn("level", left / load)
    #: The level at the first source that it does not hold at its cap.
    free = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("cap") / F.col("weight"))).over(every)
    # Of tied sources the first has the greatest level: the later ones' count it as held.
    level = F.max(F.when(F.col("cap") / F.col("weight") == F.col("free"), F.col("level"))).over(every)
    found = levels.withColumn("free", free).withColumn("at", level)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("at"), F.col("cap").cast("double")))
    return found.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document.

    Size: words of the text, a null text has none.  A source of size 0 has
    target 0 and its documents no copies.  Equal ids draw equal numbers, so
    repeated rows are taken alike; a null id draws as the text "null".  Reruns
    agree, however the rows are partitioned.
    """
    require(docs, "doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goals = materialize(targets(per_source, list(weights), most), "mix-targets")
    few = goals.limit(SMALL + 1).count() <= SMALL
    goals = goals.withColumnRenamed("source", "goal_source")
    rows = sized.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("goal_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    extra = (hash_rate(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return rows.withColumn("rate", rate).select(
        "doc_id", "source", "size", "source_size", "target", F.least(whole + extra, F.lit(most)).cast("long").alias("copies")
    )


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the input's columns.

    The decision of a row depends on its id and source alone, so it is joined
    back per source, without moving a text.
    """
    require(docs, "doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    per_source = docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goals = materialize(targets(per_source, list(weights), most), "mix-targets")
    few = goals.limit(SMALL + 1).count() <= SMALL
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.select(F.col("source").alias("__goal"), rate.alias("__rate"))
    rows = docs.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("__goal")))
    whole = F.floor("__rate")
    extra = (hash_rate(F.col("doc_id"), seed) < F.col("__rate") - whole).cast("long")
    copies = F.least(whole + extra, F.lit(most)).cast("int")
    taken = rows.withColumn("__copies", copies).filter(F.col("__copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op4_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mix(docs).select("doc_id", "size", "source_size", "target", taken)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight,
         source_size * 3 AS cap
  FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, (source IS NULL), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, min(CASE WHEN cap >= weight * level THEN CAST(cap AS DOUBLE) / weight END) OVER () AS free FROM l
), g AS (
  SELECT *, min(CASE WHEN CAST(cap AS DOUBLE) / weight = free THEN level END) OVER () AS lev FROM f
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * lev, CAST(cap AS DOUBLE))) AS target FROM g
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM r
"""
