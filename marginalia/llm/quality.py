"""Quality classifier: a factorisation machine over whole texts.

Features of a text: its hashed words (square-rooted counts, L2-normalised),
structure statistics, and metadata (the size class of ``n_chars``).  The score
is w0 + sum w_i x_i + the pairwise interactions of low rank, in time linear in
the features: 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2).

Training uses a bounded sample of labelled rows; scoring is one narrow pass
over all rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.columns import extended, held_out, record_batch, require
from marginalia.llm.sampling import per_label
from marginalia.llm.textblocks import BLOCK, SPACE, blocks, words

WORD_BITS = 14
RANK = 8
STATS = (
    "words characters_per_word upper_share symbol_share digit_share bar_share exclamation_share "
    "distinct_words repeated_neighbours distinct_lines words_per_line longest_word commonest_word"
).split()
SIZE_CLASSES = 24  # of n_chars: none, then by power of two
WORDS, FIRST_STAT = 1 << WORD_BITS, 1 << WORD_BITS
FIRST_SIZE = FIRST_STAT + len(STATS)
FEATURES = FIRST_SIZE + SIZE_CLASSES

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = ~(_LETTER | _DIGIT | SPACE)
_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True


def _counts(mask: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are in the mask."""
    sums = np.zeros(len(raw) + 1, dtype=np.int64)
    for at in range(0, len(raw), 4 * BLOCK):
        part = mask[raw[at : at + 4 * BLOCK]]
        sums[at + 1 : at + 1 + len(part)] = np.cumsum(part) + sums[at]
    return np.diff(sums[offsets])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their counts."""
    ordered = np.sort(keys)
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[new], np.diff(np.append(new, len(ordered)))


def features(raw: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a block, sorted by row.  ``sizes``: n_chars, below 0 where null."""
    n = len(offsets) - 1
    w = words(raw, offsets)
    total = np.bincount(w.row, minlength=n)
    length = np.diff(offsets)
    some = np.maximum(total, 1)

    bucket = (w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = _runs((w.row.astype(np.int64) << WORD_BITS) | bucket)
    row, feature = key >> WORD_BITS, key & (WORDS - 1)
    value = np.sqrt(count / some[row])

    group, times = _runs((w.row.astype(np.uint64) << np.uint64(44)) | (w.hashes >> np.uint64(20)))
    of = (group >> np.uint64(44)).astype(np.int64)
    distinct = np.bincount(of, minlength=n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, of, times)
    again = np.zeros(n)
    if len(w.hashes) > 1:
        same = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
        again = np.bincount(w.row[1:][same], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, w.row, w.end - w.start)

    lines = words(raw, offsets, _LINE_END)
    line_count = np.bincount(lines.row, minlength=n)
    line_key, _ = _runs((lines.row.astype(np.uint64) << np.uint64(44)) | (lines.hashes >> np.uint64(20)))
    line_kinds = np.bincount((line_key >> np.uint64(44)).astype(np.int64), minlength=n)

    letters, bytes_ = np.maximum(_counts(_LETTER, raw, offsets), 1), np.maximum(length, 1)
    bar, mark = np.zeros(256, bool), np.zeros(256, bool)
    bar[ord("|")], mark[ord("!")] = True, True
    stats = np.stack(
        [
            np.log1p(total) / 4,
            np.minimum(length / some, 40) / 8,
            _counts(_UPPER, raw, offsets) / letters * 3,
            np.minimum(_counts(_SYMBOL, raw, offsets) / bytes_, 0.3) * 10,
            _counts(_DIGIT, raw, offsets) / bytes_ * 5,
            np.minimum(_counts(bar, raw, offsets) / some, 1) * 3,
            np.minimum(_counts(mark, raw, offsets) / some, 1) * 3,
            np.where(total > 0, distinct / some, 1) * np.minimum(np.log1p(total), 5) / 2,
            again / some * 3,
            np.where(line_count > 0, line_kinds / np.maximum(line_count, 1), 1),
            np.log1p(total / np.maximum(line_count, 1)) / 4,
            np.log1p(longest) / 4,
            np.where(total > 9, commonest / some, 0) * 4,
        ],
        axis=1,
    )
    size = np.clip(np.where(sizes >= 0, 1 + np.floor(np.log2(np.maximum(sizes, 0) + 1)), 0), 0, SIZE_CLASSES - 1).astype(np.int64)
    every = np.arange(n)
    row = np.concatenate([row, np.repeat(every, len(STATS)), every])
    feature = np.concatenate([feature, np.tile(FIRST_STAT + np.arange(len(STATS)), n), FIRST_SIZE + size])
    value = np.concatenate([value, stats.ravel(), np.full(n, 0.5)])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order].astype(np.float32)


@dataclass
class Machine:
    """Weights of a factorisation machine; probability = logistic of its output."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        stat = (feature >= FIRST_STAT) & (feature < FIRST_SIZE)
        out = value.copy()
        k = feature[stat] - FIRST_STAT
        out[stat] = np.clip((value[stat] - self.mean[k]) / self.scale[k], -4, 4) / 2
        return out

    def margin(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """By the sum-of-squares identity; rows must be sorted and none empty."""
        x = self.standard(feature, value)
        at = np.searchsorted(row, np.arange(n))
        vx = self.factors[feature] * x[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        q = np.add.reduceat((vx * vx).sum(1), at)
        return self.bias + np.add.reduceat(self.linear[feature] * x, at) + 0.5 * ((s * s).sum(1) - q)

    def probability(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(row, feature, value, n), -40, 40)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, step: float = 0.05, seed: int = 11) -> Machine:
    """AdaGrad on the logistic loss, classes weighted alike up to a factor; batches of 32 texts."""
    rng = np.random.default_rng(seed)
    stats = np.array([v[(f >= FIRST_STAT) & (f < FIRST_SIZE)] for f, v in docs], dtype=np.float64)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, RANK)), stats.mean(0), stats.std(0) + 1e-3)
    x = [(f, m.standard(f, v).astype(np.float64)) for f, v in docs]
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y > 0, 1.0, min(np.sqrt(share / (1 - share)), 4.0)) if 0 < y.mean() < 1 else np.ones(len(y))
    past_w, past_v, past_b = np.full(FEATURES, 1e-4), np.full((FEATURES, RANK), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 32):
            own = order[lo : lo + 32]
            feature = np.concatenate([x[i][0] for i in own])
            value = np.concatenate([x[i][1] for i in own])
            sizes = np.array([len(x[i][0]) for i in own])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = m.factors[feature]
            vx = v * value[:, None]
            s = np.add.reduceat(vx, at, axis=0)
            out = m.bias + np.add.reduceat(m.linear[feature] * value, at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), at))
            g = weight[own] * (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[own]) / len(own)
            each = np.repeat(g, sizes)
            seen, back = np.unique(feature, return_inverse=True)
            gw = np.bincount(back, each * value) + 1e-4 * m.linear[seen]
            gv = np.zeros((len(seen), RANK))
            np.add.at(gv, back, (each * value)[:, None] * (np.repeat(s, sizes, axis=0) - vx))
            gv += 1e-3 * m.factors[seen]
            past_w[seen] += gw**2
            past_v[seen] += gv**2
            past_b += g.sum() ** 2
            m.linear[seen] -= step * gw / np.sqrt(past_w[seen])
            m.factors[seen] -= step * 0.2 * gv / np.sqrt(past_v[seen])
            m.bias -= step * g.sum() / np.sqrt(past_b)
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    if name not in batch.schema.names:
        return np.full(batch.num_rows, -1.0)
    return batch.column(name).cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, train_on, per_class: int = 3000, seed: str = "quality") -> Machine | float:
    """Learn ``labels.quality`` from the rows where ``train_on`` holds.

    A sample of about ``per_class`` rows a class, chosen by hash, is used; its
    feature vectors alone come to the driver.  With a single class or no rows
    the result is a constant probability.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality")
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(train_on)
    sample = per_label(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "quality", "doc_id", per_class, seed)
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    rows = docs.select("doc_id", "text", size.alias("n_chars")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "n_chars", "quality")
    schema = pa.schema([("doc_id", pa.string()), ("y", pa.int64()), ("features", pa.binary()), ("values", pa.binary())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, y = _sizes(batch, "n_chars"), batch.column("quality").cast(pa.int64())
            for lo, hi, raw, offsets in blocks(batch.column("text")):
                row, feature, value = features(raw, offsets, size[lo:hi])
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                f = [feature[a:b].astype(np.uint16).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                v = [value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield record_batch(schema, [batch.column("doc_id").cast(pa.string())[lo:hi], y[lo:hi], f, v])

    made = rows.mapInArrow(vectors, "doc_id string, y long, features binary, values binary").collect()
    got = sorted((r["doc_id"], r["y"], bytes(r["features"]), bytes(r["values"])) for r in made)
    y = np.array([g[1] for g in got], dtype=np.float64)
    if not got or y.min() == y.max():
        return float(y.mean()) if got else 0.5
    return train([(np.frombuffer(g[2], np.uint16).astype(np.int64), np.frombuffer(g[3], np.float32)) for g in got], y)


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """Add ``score`` double, 0 to 1, to every row; a null text scores as an empty one.

    ``n_chars`` is read as metadata where the table has it (null: a class of its
    own).  Repeated rows stay; an input column ``score`` is replaced.
    """
    require(docs, "text")
    kept = docs.select(*[c for c in docs.columns if c != "score"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                size = _sizes(batch, "n_chars")
                for lo, hi, raw, offsets in blocks(batch.column("text")):
                    out[lo:hi] = model.probability(*features(raw, offsets, size[lo:hi]), hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(rate, extended(kept, "score double"))


def op6_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted; crc32(doc_id) mod 4 = 2 is held out of training."""
    require(docs, "doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs, labels, ~out, per_class)
    rows = docs.select("doc_id", "text", *["n_chars"] * ("n_chars" in docs.columns))
    scored = score(rows, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
