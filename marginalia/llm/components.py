"""Connected components of an edge table, by alternating stars.

Every round is a minimum per node (map-side combined) joined back to the edges;
nothing is gathered per node, so a node with very many edges costs no task more
than its share (adaptive execution splits the skewed join).  Lineage is cut by a
written table each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.scratch import materialize, release


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node that it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = down.join(_least(down), "u")
    moved = tied.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(tied.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node with an edge; root is the least node of its component.

    Self-loops and repeated edges are allowed and change nothing; an empty edge
    table gives no rows.  Rounds go on until one changes nothing; their number
    grows with the logarithm of a component's size.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now, before = materialize(now, "cc"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == before:
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = mark
        step = materialize(_small_star(_large_star(now)).distinct(), "cc")
        release(now)
        now = step
