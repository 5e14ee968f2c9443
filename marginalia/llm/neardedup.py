"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

1. Every text becomes its set of word shingles, a fingerprint of that set and a
   HyperMinHash sketch.  Equal sets are one node from here on.
2. The compressed registers are banded; nodes that share a band key meet.  Keys
   with the same members are met once.
3. Within a key, collision-corrected estimates join what may be similar, and a
   forest of those candidate links leaves the task - never all pairs.
4. Each candidate group then has its texts compared exactly, by counting common
   shingles, and again only a forest of the true links leaves.
5. Connected components of the links are the groups of near copies.

Keys and groups of any size are dealt out as pairs of blocks of bounded size.
With 42 bands of 6 registers, a pair at the threshold of 0.8 is missed by
banding with probability 3e-6; ``SLACK`` is five standard errors of the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.columns import record_batch, require
from marginalia.llm.components import components
from marginalia.llm.hyperminhash import BUCKETS, MANTISSA, band_keys, levels, sketch
from marginalia.llm.textblocks import blocks, mix, shingles, words
from marginalia.scratch import materialize

ROWS = 6
SLACK = 0.14
#: Members of a block, and shingles of a block of texts.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 20
#: A list of ids up to this long may be broadcast (8 bytes each).
FEW_IDS = 500_000

_SALT = np.uint64(0x2545F4914F6CDD1D)


def node_id(h: np.ndarray) -> int:
    """A 64-bit fingerprint of a set of hashes, signed."""
    a, b = int(mix(h).sum(dtype=np.uint64)), int(mix(h ^ _SALT).sum(dtype=np.uint64))
    return int(mix(np.array([a ^ (b * 3 + len(h)) % (1 << 64)], dtype=np.uint64)).astype(np.int64)[0])


def shingle_sets(docs: DataFrame, width: int, id_column: str = "doc_id") -> DataFrame:
    """id, n_shingles, node, sketch of every row; node and sketch are null for an empty set."""
    kind = docs.schema[id_column].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column(1)):
                h, row = shingles(words(raw, offsets), hi - lo, width)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                own = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                nodes = pa.array([node_id(x) if len(x) else None for x in own], pa.int64())
                made = pa.array([sketch(x).tobytes() if len(x) else None for x in own], pa.binary())
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), nodes, made]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "node", "sketch"])

    return docs.select(id_column, "text").mapInArrow(sets, f"id {kind}, n_shingles long, node long, sketch binary")


def texts_by_node(docs: DataFrame, width: int) -> DataFrame:
    """node, id, text of rows (id, text); an id may have rows of different texts, so each text's own node is found."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column(1)):
                h, row = shingles(words(raw, offsets), hi - lo, width)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                nodes = [node_id(h[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                arrays = [pa.array(nodes, pa.int64()), *(c.slice(lo, hi - lo) for c in batch.columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "id", "text"])

    return docs.mapInArrow(name, f"node long, id {docs.schema['id'].dataType.simpleString()}, text string")


class Forest:
    """Union-find over places 0..n-1 that keeps the unions it made."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.made: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.made.append((x, y))


def _span(forest: Forest, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
    """Join along a matrix of links; only until all are joined."""
    for k in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[k]):
            forest.join(int(left[k]), int(right[j]))


def _sides(block: np.ndarray, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(block == bi), np.flatnonzero(block == bj)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order that brings equal keys together, and the runs in it."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for k in keys:
        own = k[order]
        change[1:] |= own[1:] != own[:-1]
    edge = np.append(np.flatnonzero(change), len(order))
    return order, [*zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def dealt(rows: DataFrame, key: str, parts) -> DataFrame:
    """Deal each group of ``key`` out as pairs of ``parts`` blocks: adds bi, bj, block.

    A member of block b goes to every pair (b, x) and (x, b) with bi <= bj.
    """
    block = F.pmod(F.xxhash64("node"), parts).cast("int")
    out = rows.withColumn("parts", parts.cast("int")).withColumn("block", block)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "parts")


def candidate_groups(nodes: DataFrame, threshold: float) -> DataFrame:
    """node, root: groups of nodes that candidate links hold together.

    ``nodes``: node, n_shingles, sketch, one row a node.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])
        for batch in batches:
            node = batch.column(0).to_numpy()
            for lo in range(0, len(node), 2048):
                registers = np.frombuffer(b"".join(batch.column(1).slice(lo, 2048).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                keys = band_keys(registers, ROWS)
                yield record_batch(schema, [keys.ravel().astype(np.int64), np.repeat(node[lo : lo + 2048], keys.shape[1])])

    keyed = nodes.select("node", "sketch").mapInArrow(bands, "key long, node long")
    sums = [
        F.count("*").alias("m"),
        F.sum(F.shiftright(F.xxhash64("node"), 24)).alias("s"),
        F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x"),
    ]
    met = keyed.groupBy("key").agg(*sums).filter(F.col("m") > 1)
    once = met.groupBy("m", "s", "x").agg(F.min("key").alias("key")).select("key", "m")
    members = materialize(keyed.join(once, "key"), "near-keys")
    total = members.count()
    tasks = max(1, total // 20_000)
    split = dealt(members, "key", F.ceil(F.col("m") / BLOCK_NODES))
    split = split.join(nodes, "node").withColumn("task", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(tasks)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = threshold - SLACK

    def meet(table: pa.Table) -> pa.Table:
        key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
        block, bi, bj = (table.column(c).to_numpy() for c in ("block", "bi", "bj"))
        size = table.column("n_shingles").to_numpy().astype(np.float64)
        registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        order, runs = _runs(key, bi, bj)
        found: list[np.ndarray] = []
        for lo, hi in runs:
            own = order[lo:hi]
            left, right = _sides(block[own], int(bi[own[0]]), int(bj[own[0]]))
            forest = Forest(len(own))
            ours, sizes = registers[own], size[own]
            places = levels(sizes)
            for k, i in enumerate(left):
                js = right[k + 1 :] if bi[own[0]] == bj[own[0]] else right
                if not len(js):
                    continue
                n, m = sizes[i], sizes[js]
                near = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
                js = js[near]
                if not len(js):
                    continue
                agree = (ours[js] == ours[i]).mean(axis=1)
                accident = places[js] @ places[i] / (1 << MANTISSA)
                js = js[(agree - accident) / (1 - accident) >= least]
                for j in js:
                    forest.join(int(i), int(j))
            if forest.made:
                x = np.array(forest.made)
                found.append(np.stack([node[own[x[:, 0]]], node[own[x[:, 1]]]]))
        if not found:
            return schema.empty_table()
        a, b = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    links = split.select("task", "key", "node", "block", "bi", "bj", "n_shingles", "sketch").groupBy("task").applyInArrow(meet, "a long, b long")
    return components(links, "a", "b")


def confirmed_links(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: a forest of the links that full sets confirm, within each candidate group.

    ``groups``: node, root, n_shingles; ``texts``: node, text.  A link: 100 times
    the common shingles are ``percent`` times those of either, or more.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("w") / BLOCK_SHINGLES))
    weight = groups.agg(F.sum("n_shingles").alias("w")).first()["w"] or 0
    split = dealt(groups.join(sizes, "root"), "root", parts)
    tasks = max(1, int(weight) // (BLOCK_SHINGLES // 2))
    split = split.join(texts, "node").withColumn("task", F.pmod(F.xxhash64("root", "bi", "bj"), F.lit(tasks)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(table: pa.Table) -> pa.Table:
        root, node = table.column("root").to_numpy(), table.column("node").to_numpy()
        block, bi, bj = (table.column(c).to_numpy() for c in ("block", "bi", "bj"))
        text = table.column("text").combine_chunks()
        order, runs = _runs(root, bi, bj)
        found: list[np.ndarray] = []
        for lo, hi in runs:
            own = order[lo:hi]
            hashes, row, base = [], [], 0
            for a, b, raw, offsets in blocks(text.take(pa.array(own))):
                h, r = shingles(words(raw, offsets), b - a, width)
                hashes.append(h)
                row.append(r + a)
            h, r = np.concatenate(hashes), np.concatenate(row)
            size = np.bincount(r, minlength=len(own))
            left, right = _sides(block[own], int(bi[own[0]]), int(bj[own[0]]))
            common = _common(h, r, len(own), left, right)
            either = size[left][:, None] + size[right][None, :] - common
            linked = (100 * common >= percent * either) & (either > 0)
            forest = Forest(len(own))
            _span(forest, left, right, linked)
            if forest.made:
                x = np.array(forest.made)
                found.append(np.stack([node[own[x[:, 0]]], node[own[x[:, 1]]]]))
        if not found:
            return schema.empty_table()
        a, b = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return split.select("task", "root", "node", "block", "bi", "bj", "text").groupBy("task").applyInArrow(confirm, "a long, b long")


def _common(h: np.ndarray, row: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many hashes each left row shares with each right row, exactly.

    Products of 0/1 matrices over slices of the hashes that two rows have at
    least; float32 sums stay exact below 2**24 and each slice is narrower.
    """
    kinds, code, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    code, row = shared[code[keep]], row[keep]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((n, min(width, int(code[b - 1]) - lo + 1)), dtype=np.float32)
        m[row[a:b], code[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id, kept of every row.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; a text
    of fewer than ``width`` words has its whole sequence as its one shingle; a
    text that is null, empty or without words has none and links with nothing.
    component_id is the least id that links reach, the row's own included; kept
    tells whether it is the row's own.  Repeated rows of one id share its
    component.  A null id belongs to its component but is never its least.
    """
    require(docs, id_column, "text")
    sets = materialize(shingle_sets(docs, width, id_column), "near-sets")
    full = sets.filter(F.col("node").isNotNull())
    classes = materialize(full.groupBy("node").agg(F.min("id").alias("least"), F.first("n_shingles").alias("n_shingles")), "near-classes")
    first = full.select("id", "node", "n_shingles", "sketch").join(classes.select(F.col("node").alias("of"), "least"), (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")))
    nodes = materialize(first.select("node", "n_shingles", "sketch").dropDuplicates(["node"]), "near-nodes")
    groups = materialize(candidate_groups(nodes, percent / 100).join(classes, "node"), "near-groups")
    wanted, few = groups.select(F.col("node").alias("of"), "least"), groups.count() <= FEW_IDS
    hint = F.broadcast if few else (lambda df: df)
    named_docs = docs.select(F.col(id_column).alias("id"), "text")
    if _repeats(sets):
        held = named_docs.join(hint(wanted.select("least").distinct()), F.col("id").eqNullSafe(F.col("least")), "left_semi")
        own = texts_by_node(held, width).join(hint(wanted), (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")))
        texts = own.groupBy("node").agg(F.first("text").alias("text"))
    else:
        texts = named_docs.join(hint(wanted), F.col("id").eqNullSafe(F.col("least"))).select(F.col("of").alias("node"), "text")
    links = confirmed_links(groups.select("node", "root", "n_shingles"), texts, width, percent)
    linked = components(links, "a", "b").join(classes.select("node", "least"), "node")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    joined = linked.join(lowest, "root").select("node", "lowest")
    named = classes.join(joined, "node", "left").select(F.col("node").alias("of"), F.coalesce("lowest", "least").alias("found"))
    out = sets.drop("sketch").join(named, F.col("node") == F.col("of"), "left")
    component = F.coalesce(F.col("found"), F.col("id"))
    return out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _repeats(sets: DataFrame) -> bool:
    """Whether an id has more than one row."""
    return not sets.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > 1).isEmpty()


def op3_neardedup(docs: DataFrame) -> DataFrame:
    """Groups of near copies by 4-word shingles at a Jaccard similarity of 0.8."""
    return near_duplicates(docs, width=4, percent=80)
