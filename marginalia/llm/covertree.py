"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Vectors stand on the unit sphere, where cosine c is the distance sqrt(2 - 2c).
Pivots (a net over a bounded sample) are the top level; each vector goes to the
cell of its nearest pivot, and a pair of cells whose pivots are farther apart
than both covering radii and the threshold distance is pruned.  Cells are cut
into blocks of bounded size, each block gets a cover tree - nested levels with
halving radii - and the trees of each surviving pair of blocks are descended
together, pruning node pairs by their covering radii.  What is left is decided
by the cosine in double precision.

Equal vectors are one node with a count.  A block pair emits one row a linked
vector (its number of links, and a fellow member of its local component), never
the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.columns import record_batch, require
from marginalia.llm.components import components
from marginalia.llm.neardedup import Forest
from marginalia.llm.topk import usable
from marginalia.scratch import materialize

#: Vectors of a block; vectors of the sample for pivots; pivots at most.
BLOCK, SAMPLE, PIVOTS = 4096, 4096, 512
#: Rounding allowance of a distance that is computed from a product.
SAFE, SAFE_32 = 1e-6, 1e-5
LEAF = 24


@dataclass
class Node:
    center: int
    radius: float
    members: np.ndarray
    children: list[Node]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover(x: np.ndarray, members: np.ndarray, center: int, reach: float) -> Node:
    """A node over ``members``, all within its covering radius of ``center``; children at half the reach."""
    d = _distance(x[members], x[center : center + 1])[:, 0]
    node = Node(center, float(d.max()) if len(members) > 1 else 0.0, members, [])
    if len(members) <= LEAF and node.radius < 1:
        return node
    half = reach / 2
    while half > 1e-3 and node.radius <= half:
        half /= 2
    if half <= 1e-3:
        return node
    own = x[members].astype(np.float32)
    near = (own @ own.T) >= 1 - half * half / 2
    free = near.sum(axis=1) > 1  # the others are nodes of their own
    node.children = [Node(int(members[k]), 0.0, members[k : k + 1], []) for k in np.flatnonzero(~free)]
    first = int(np.flatnonzero(members == center)[0])
    rest = np.flatnonzero(free)
    order = [first, *rest[rest != first].tolist()]  # the centre is a centre below too
    for k in order:
        if free[k]:
            took = np.flatnonzero(near[k] & free)
            took = took if k in took else np.append(took, k)
            free[took] = False
            node.children.append(cover(x, members[took], int(members[k]), half))
    return node


@dataclass
class Found:
    """Links of one block pair: how many each place has, and the local components."""

    links: np.ndarray
    forest: Forest


def _decide(x: np.ndarray, raw: np.ndarray, norm: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, out: Found) -> None:
    """Pairs of places by the cosine in double precision."""
    same = a != b
    a, b = a[same], b[same]
    for lo in range(0, len(a), 1 << 16):
        i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        good = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= least
        i, j = i[good], j[good]
        np.add.at(out.links, i, copies[j])
        np.add.at(out.links, j, copies[i])
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            out.forest.join(p, q)


def _lower(nodes: list[Node], reach: float) -> list[Node]:
    """The nodes, those of a large radius replaced by their children or their members."""
    out: list[Node] = []
    for n in nodes:
        if n.radius <= reach / 4:
            out.append(n)
        elif n.children:
            out += n.children
        else:
            out += [Node(int(m), 0.0, n.members[k : k + 1], []) for k, m in enumerate(n.members)]
    return out


def _near(x32: np.ndarray, ones: list[Node], twos: list[Node], reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of node pairs that the covering radii don't prune.

    A distance above r is a product below 1 - r^2 / 2; products in single
    precision are off by less than ``SAFE_32``.  Nodes without a radius, most
    of a sparse level, share one bound.
    """
    ra, rb = np.array([n.radius for n in ones]), np.array([n.radius for n in twos])
    ca, cb = x32[[n.center for n in ones]], x32[[n.center for n in twos]]
    wide_a, wide_b = np.flatnonzero(ra > 0), np.flatnonzero(rb > 0)
    thin_a = np.flatnonzero(ra == 0)
    least = 1 - (reach + SAFE) ** 2 / 2 - SAFE_32

    def bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        r = np.minimum(ra[p][:, None] + rb[q][None] + reach + SAFE, 2.0)
        return (1 - r * r / 2 - SAFE_32).astype(np.float32)

    thin_b = np.flatnonzero(rb == 0)
    every = np.arange(len(twos))
    for own, its, flat in ((thin_a, thin_b, True), (thin_a, wide_b, False), (wide_a, every, False)):
        for lo in range(0, len(own) if len(its) else 0, 1024):
            part = own[lo : lo + 1024]
            dot = ca[part] @ cb[its].T
            p, q = np.nonzero(dot >= least if flat else dot >= bound(part, its))
            yield part[p], its[q]


def dual(x: np.ndarray, top: list[tuple[Node, Node]], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of vectors within ``reach``, or a little more, of each other.

    A pair of a node with itself yields each of its pairs once.
    """
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    todo = top
    x32 = x.astype(np.float32)
    while todo:
        a, b = todo.pop()
        if not a.children and not b.children or len(a.members) * len(b.members) <= LEAF * LEAF:
            i, j = a.members, b.members
            near = _distance(x[i], x[j]) <= reach + SAFE
            if a is b:
                near &= np.triu(np.ones(near.shape, dtype=bool), 1)
            p, q = np.nonzero(near)
            left.append(i[p])
            right.append(j[q])
            continue
        ones = a.children or [a]
        twos = ones if a is b else b.children or [b]
        while True:
            sizes_a, sizes_b = (np.array([len(n.members) for n in side]) for side in (ones, twos))
            met = [(p[p <= q], q[p <= q]) if a is b else (p, q) for p, q in _near(x32, ones, twos, reach)]
            wide = sum(int((sizes_a[p] * sizes_b[q] > 1).sum()) for p, q in met)
            if wide <= 4 * (len(ones) + len(twos)):
                break
            # Hardly anything was pruned at this level: both sides go a level down at once.
            lower = _lower(ones, reach)
            below = lower if a is b else _lower(twos, reach)
            if len(lower) + len(below) == len(ones) + len(twos):
                break
            ones, twos = lower, below
        for p, q in met:
            if not len(p):
                continue
            single = sizes_a[p] * sizes_b[q] == 1
            # Two nodes of one vector each are within reach; the same one is no pair.
            s = single & ~((p == q) & (a is b))
            left.append(np.array([ones[k].center for k in p[s]], dtype=np.int64))
            right.append(np.array([twos[k].center for k in q[s]], dtype=np.int64))
            todo += [(ones[i], twos[j]) for i, j in zip(p[~single].tolist(), q[~single].tolist(), strict=True)]
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def net(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots by farthest-first traversal, the greedy net of a cover tree's upper levels."""
    chosen = [0]
    gap = _distance(sample, sample[:1])[:, 0]
    while len(chosen) < min(most, len(sample)):
        k = int(gap.argmax())
        if gap[k] <= 1e-3:
            break
        chosen.append(k)
        gap = np.minimum(gap, _distance(sample, sample[k : k + 1])[:, 0])
    return sample[chosen]


def _unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    return raw / norm[:, None], norm


def _matrix(column, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(n, -1)


def linked_vectors(classes: DataFrame, least: float, count: int) -> DataFrame:
    """id, mate, links: rows of partial results over ``classes`` (id, copies, vector), all of one length."""
    reach = float(np.sqrt(2 - 2 * least))
    pivots_wanted = int(min(PIVOTS, max(1, -(-count // BLOCK))))
    rate = min(1.0, SAMPLE / count)
    picked = classes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20)).select("id", "vector").orderBy("id").limit(2 * SAMPLE).collect()
    if not picked:
        picked = classes.select("id", "vector").limit(1).collect()
    pivots = net(_unit(np.array([r["vector"] for r in picked], dtype=np.float64))[0], pivots_wanted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distance(_unit(_matrix(batch.column("vector"), batch.num_rows))[0], pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "away"]
            )

    placed = materialize(classes.mapInArrow(assign, "id long, copies long, vector array<double>, cell int, away double"), "cover-cells")
    cells = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    between = _distance(pivots, pivots)
    parts = {c: -(-n // BLOCK) for c, (n, _) in cells.items()}
    pairs = [(a, b) for a in cells for b in cells if a <= b and between[a, b] <= cells[a][1] + cells[b][1] + reach + SAFE]
    # Two rows a surviving pair of cells; the number of pivots bounds it.
    sent = [(a, b, parts[a], parts[b]) for a, b in pairs] + [(b, a, parts[b], parts[a]) for a, b in pairs if a != b]
    spark = classes.sparkSession
    meets = F.broadcast(spark.createDataFrame(sent, "cell int, with int, parts int, with_parts int"))
    rows = placed.join(meets, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with_part", F.explode(F.sequence(F.lit(0), F.col("with_parts") - 1)))
    own, other = F.struct(F.col("cell").alias("c"), F.col("part").alias("p")), F.struct(F.col("with").alias("c"), F.col("with_part").alias("p"))
    rows = rows.withColumn("lo", F.least(own, other)).withColumn("hi", F.greatest(own, other)).withColumn("low", own == F.col("lo"))
    schema = pa.schema([("id", pa.int64()), ("mate", pa.int64()), ("links", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        low = table.column("low").to_numpy(zero_copy_only=False)
        raw = _matrix(table.column("vector"), len(ids))
        x, norm = _unit(raw)
        sides = [np.flatnonzero(low), np.flatnonzero(~low)]
        trees = [cover(x, s, int(s[0]), 2.0) for s in sides if len(s)]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        if lo != hi and len(trees) < 2:
            return schema.empty_table()
        out = Found(np.zeros(len(ids), np.int64), Forest(len(ids)))
        top = [(trees[0], trees[0])] if lo == hi else [(trees[0], trees[1])]
        i, j = dual(x, top, reach)
        _decide(x, raw, norm, copies, i, j, least, out)
        at = np.flatnonzero(out.links)
        mate = [ids[out.forest.root(int(k))] for k in at]
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(mate, pa.int64()), pa.array(out.links[at])], schema=schema)

    keys = rows.select("lo", "hi", "low", "id", "copies", "vector")
    return keys.groupBy("lo", "hi").applyInArrow(meet, "id long, mate long, links long")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row.

    n_links: other rows with cosine >= ``least``; component_id: the least id
    that links reach, the row's own included; kept: whether it is the row's own.
    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing, nor do vectors of different length.  Equal vectors link
    with each other, rows of one id too.  Ids are integers; a null id keeps null.
    """
    require(vectors, id_column, vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    sound = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    keyed = rows.withColumn("good", F.coalesce(sound & F.col("id").isNotNull(), F.lit(False)))
    keyed = keyed.withColumn("k1", F.when(F.col("good"), F.xxhash64("vector"))).withColumn("k2", F.when(F.col("good"), F.xxhash64("vector", F.lit(1))))
    groups = keyed.filter("good").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = materialize(groups, "cover-classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    partial = None
    for d, n in sorted(sizes.items()):
        made = linked_vectors(classes.filter(F.size("vector") == d).select("id", "copies", "vector"), least, n)
        partial = made if partial is None else partial.union(made)
    if partial is None:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    partial = materialize(partial, "cover-links")
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(partial, "id", "mate").select(F.col("node").alias("id"), "root")
    known = classes.select("k1", "k2", "id", "copies").join(links, "id", "left").join(roots, "id", "left")
    known = known.select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("found")
    )
    out = keyed.select("id", "k1", "k2").join(known, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce(F.col("found"), F.col("id"))
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def op9_covertree(embeddings: DataFrame) -> DataFrame:
    """Links at cosine 0.9 over all rows, whatever their labels."""
    return near_duplicate_vectors(embeddings)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.9
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM p GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
