"""Exact top-k inner products by no-random-access aggregation.

Each dimension is a list of candidates sorted by their contribution to a
query's score.  All lists are read sequentially to the same depth; a candidate
seen in some lists has a lower and an upper bound of its score, one seen in
none is bounded by the lists' frontiers.  Only entries that the reading has
passed enter a bound.  Reading goes deeper until no candidate outside the k best
lower bounds can still qualify, then the scores of those that remain are
resolved exactly.

Queries and candidates meet in blocks of bounded size, (query block x candidate
block), each of which runs on its own; a threshold carries over between the
candidate chunks within a block, so later chunks stop earlier or are skipped
whole.  At most k rows a query and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.columns import require

#: Rows of a candidate chunk whose lists are sorted together.
CHUNK = 4096


class Lists:
    """The sorted lists of one chunk, one a dimension, greatest component first.

    ``place`` and ``sorted`` are a list's entries, row and component; ``rank`` is
    where a row stands in each list.  Components are read from the lists alone;
    the rows themselves only give the scores of those that remain.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.start = ids, values, len(ids) // 2
        self.place = np.argsort(-values.T, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values.T, self.place, axis=1)
        self.rank = np.argsort(self.place, axis=1).astype(np.int32)

    def read(self, total: np.ndarray, lists: np.ndarray, weights: np.ndarray, begin: int, end: int) -> None:
        """Add the entries ``begin`` to ``end`` of ``lists`` to the totals of their rows."""
        rows = self.place[lists, begin:end].ravel()
        shares = (self.sorted[lists, begin:end] * weights[lists, None]).ravel()
        if total.dtype == np.float64:
            total += np.bincount(rows, shares, len(total))
        else:
            np.add.at(total, rows, shares)

    def top(self, weights: np.ndarray, k: int, floor: int | None, exclude: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that may be among the k best, with exact scores.

        ``floor``: a score that k others reach already.  ``exclude``: the
        query's own id.  Lists of positive weight are read from their head, those
        of negative weight from their tail, those of weight 0 not at all.  Down
        to ``depth`` a row has the total of the entries read; an entry not read
        yet lies between its list's far end and its frontier.
        """
        n = len(self.values)
        heads, tails = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        if floor is not None and self.sorted[heads, 0] @ weights[heads] + self.sorted[tails, -1] @ weights[tails] < floor:
            return self.ids[:0], self.ids[:0]
        far = np.concatenate([self.sorted[heads, -1] * weights[heads], self.sorted[tails, 0] * weights[tails]])
        total = np.zeros(n, weights.dtype)
        alive = np.flatnonzero(self.ids != exclude)
        done, depth = 0, min(n, max(4 * k, self.start))
        while True:
            self.read(total, heads, weights, done, depth)
            self.read(total, tails, weights, n - depth, n - done)
            near = np.concatenate([self.sorted[heads, depth - 1] * weights[heads], self.sorted[tails, n - depth] * weights[tails]])
            ranks = self.rank if len(alive) == n else self.rank[:, alive]
            unread = np.concatenate([ranks[heads] >= depth, ranks[tails] < n - depth]).astype(weights.dtype)
            high = total[alive] + near @ unread
            line = floor
            if len(alive) >= k:
                low = total[alive] + far @ unread
                kth = np.partition(low, len(low) - k)[len(low) - k]
                line = kth if line is None else max(line, kth)
            if line is not None:
                alive = alive[high >= line]  # outsiders, seen or not, cannot qualify
            if len(alive) <= 4 * k or depth == n:
                self.start = (self.start + depth) // 2  # near where the next query is likely to stop
                return self.ids[alive], (self.values[alive] @ weights).astype(np.int64)
            done, depth = depth, min(n, depth + max(1, (n - depth + 1) // 2))


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """id and ``q``, the components as floor(scale * x) with x as double; unusable vectors are left out."""
    rows = vectors.filter(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
    whole = F.transform(F.col(vector_column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.select(F.col(id_column).cast("long").alias("id"), whole.alias("q"))


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 512, candidate_block: int = 16384
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products.

    Inputs: ``id`` long, ``q`` array<long>.  A query never meets rows of its own
    id; ties go to the smaller id; fewer than k rows where there are fewer
    candidates; vectors of different length never meet.  Repeated rows count as
    they are.  Components are integers, so scores are exact within 64 bits.
    """
    sizes = queries.agg(F.count("*").alias("n")).first()["n"], candidates.agg(F.count("*").alias("n")).first()["n"]
    q_blocks, c_blocks = max(1, -(-sizes[0] // query_block)), max(1, -(-sizes[1] // candidate_block))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dims = F.size("q").alias("dims")
    left = queries.select("id", "q", dims, block(q_blocks, 1).alias("qb")).withColumn("cb", every(c_blocks))
    right = candidates.select("id", "q", dims, block(c_blocks, 2).alias("cb")).withColumn("qb", every(q_blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        flat = table.column("q").combine_chunks()
        return ids, np.asarray(flat.flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        qid, qv = arrays(a)
        cid, cv = arrays(b)
        if not len(qid) or not len(cid):
            return schema.empty_table()
        order = np.argsort(cid, kind="stable")
        reach = int(max(np.abs(qv).max(initial=0), 1)) * int(max(np.abs(cv).max(initial=0), 1)) * max(qv.shape[1], 1)
        if reach < 1 << 52:  # every sum is a whole number that a double holds
            qv, cv = qv.astype(np.float64), cv.astype(np.float64)
        cid, cv = cid[order], cv[order]
        chunks = [Lists(cid[i : i + CHUNK], cv[i : i + CHUNK]) for i in range(0, len(cid), CHUNK)]
        out: list[np.ndarray] = []
        for own, weights in zip(qid, qv, strict=True):
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for chunk in chunks:
                floor = int(scores[-1]) if len(scores) == k else None
                more, its = chunk.top(weights, k, floor, own)
                ids, scores = np.concatenate([ids, more]), np.concatenate([scores, its])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            out.append(np.stack([np.full(len(ids), own), ids, scores]))
        q, v, s = np.concatenate(out, axis=1)
        return pa.Table.from_arrays([pa.array(q), pa.array(v), pa.array(s)], schema=schema)

    keys = ["dims", "qb", "cb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_topk(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50; candidates are all rows."""
    require(embeddings, "vec_id", "embedding")
    rows = quantised(embeddings, "vec_id", "embedding")
    return top_k(rows.filter(F.col("id") % 50 == 0), rows, k)


ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
