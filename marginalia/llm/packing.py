"""Best-fit packing planned on a length histogram.

Documents become token pieces of at most ``capacity``; only a longer document
is cut, its first piece being what is over.  Best-fit decreasing then runs over
the counts of the lengths, not over documents: at most ``capacity`` counts
reach the driver, groups of like sequences are filled at once, and the plan is
a short table of slot ranges.  A piece takes its slot by its rank within its
length.  Ranks come from salted groups of bounded size and the cumulative
counts of those groups, so a length that holds most pieces is never sorted in
one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.columns import require
from marginalia.llm.tokens import Encoder
from marginalia.scratch import materialize

#: Pieces of one length that are ranked together.
GROUP = 50_000


class Slots(NamedTuple):
    """``count`` pieces of ``length``, from ``rank`` on, go to sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Best-fit decreasing over counts: the slot ranges and the number of sequences.

    Lengths go from long to short.  ``room``: by free space, the ranges of
    sequences that have it.  A piece goes to the fullest sequence that still
    takes it; a range of like sequences takes as many pieces as it has.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    out: list[Slots] = []
    made = 0

    def give(space: int, first: int, n: int) -> None:
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} doesn't fit in {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
                took = min(n, left)
                if n > took:
                    give(space, first + took, n - took)
            else:
                space, first = capacity, made
                took = -(-left // (capacity // length))
                made += took
            out.append(Slots(length, rank, took, first, capacity - space))
            if space > length:
                give(space - length, first, took)
            left, rank = left - took, rank + took
    return out, made


def pieces(docs: DataFrame, capacity: int, encoder: Encoder, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every row's pieces.

    The whole text is encoded, a null text as an empty one, and the end id put
    behind.  ``ids_crc32``: of the ids as little-endian unsigned 32-bit numbers.
    """
    require(docs, id_column, "text")
    fields = "start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    kind = docs.schema[id_column].dataType.simpleString()
    names = [pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    names += [pa.field("ids", pa.list_(pa.int32()))] * with_ids

    def cut(ids: np.ndarray) -> list[dict]:
        head = len(ids) % capacity or capacity
        edges = [0, *range(head, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out.append({"start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].astype("<u4").tobytes())})
            if with_ids:
                out[-1]["ids"] = ids[a:b]
        return out

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for at in range(0, len(column), 256):
                made = [cut(ids) for ids in encoder.encode(column.slice(at, 256).to_pylist())]
                arrays = [batch.column(0).slice(at, 256), pa.array(made, pa.list_(pa.struct(names)))]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_column, "pieces"])

    encoded = docs.select(id_column, "text").mapInArrow(encode, f"`{id_column}` {kind}, pieces array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    return encoded.select(id_column, F.posexplode("pieces").alias("piece", "p")).select(id_column, "piece", "p.*")


def ranked(rows: DataFrame, counts_by_group: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) within ``length``; ``rows`` and counts carry ``length`` and ``salt``."""
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts_by_group.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy(*order)
    numbered = rows.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(bases, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("base")).drop("own", "base")


def buckets(slots: list, totals: dict[int, int]) -> tuple[dict[int, int], list[tuple]]:
    """Width of a bucket of ranks for each length, and every planned range once for each bucket it reaches into.

    A length has about as many buckets as ranges, so there are at most three
    times as many rows as ranges, and a document meets few ranges of its length.
    """
    n = Counter(int(s[0]) for s in slots)
    widths = {length: max(1, -(-int(totals[length]) // k)) for length, k in n.items()}
    out = []
    for length, first, count, sequence, offset in (tuple(map(int, s)) for s in slots):
        width = widths[length]
        out += [(length, at, first, count, sequence, offset) for at in range(first // width, (first + count - 1) // width + 1)]
    return widths, out


def pack(docs: DataFrame, capacity: int = 1024, encoder: Encoder | None = None, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every row's pieces with ``sequence_id`` and ``offset``.

    Sequences are filled from 0 without gaps and hold ``capacity`` tokens at
    most; no token is dropped.  Repeated rows are packed each; an empty text is
    one piece that holds the end id alone; an empty table gives no rows.
    """
    made = pieces(docs, capacity, encoder or Encoder(), id_column, with_ids)
    salts = F.pmod(F.xxhash64(id_column, "piece", "ids_crc32"), F.lit(1 << 20)).cast("int")
    stored = materialize(made.withColumn("salt", salts), "pack-pieces")
    totals = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(totals, capacity)
    spark = docs.sparkSession
    widths, bucketed = buckets(slots, totals)
    table = spark.createDataFrame(bucketed, "of long, cell long, first long, count long, sequence long, offset long")
    steps = spark.createDataFrame(list(widths.items()), "length long, width long")  # a row a length
    parts = max(1, -(-max(totals.values(), default=0) // GROUP))
    rows = stored.withColumn("salt", F.col("salt") % parts)
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    rows = ranked(rows, counts, [id_column, "piece", "ids_crc32"])
    # ``plan`` makes fewer ranges than about capacity squared, whatever the number of documents.
    rows = rows.join(F.broadcast(steps), "length").withColumn("at", F.expr("rank div width"))
    inside = (F.col("length") == F.col("of")) & (F.col("at") == F.col("cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    placed = rows.join(F.broadcast(table), inside).withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
    return placed.select(id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def op5_packing(docs: DataFrame) -> DataFrame:
    """Sequences of at most 1024 tokens over all documents."""
    return pack(docs).withColumn("piece", F.col("piece").cast("int"))
