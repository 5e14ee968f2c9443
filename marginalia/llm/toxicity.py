"""Toxicity by maximum-scoring segments.

Every token has a log-odds score between toxic and clean text, smoothed by
Dirichlet priors: a word's prior is the corpus-wide rate, and a word that was
not seen often enough falls back on its first bytes.  One linear scan finds all
maximal-scoring segments of a text; extreme-value statistics (expected number
of segments that good in a clean text of that length, E = K n exp(-lambda S))
tell which are significant, and a logistic curve over the summed evidence is
the document's score.

The lexicon and the curve are learned on a bounded sample of labelled rows
(separate parts of it); scoring is one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.columns import extended, hash_rate, held_out, record_batch, require
from marginalia.llm.sampling import per_label
from marginalia.llm.textblocks import NOT_ALNUM, blocks, mix, words
from marginalia.scratch import materialize

HEADS = (6, 5, 4)
#: A token enters the lexicon with this z-score, log-odds and count in toxic texts at least.
LEAST_Z, LEAST_ODDS, LEAST_SEEN = 4.0, 2.0, 4
#: Weight of the Dirichlet prior, in tokens.
PRIOR = 2000.0


@dataclass
class Table:
    """Scores by token hash: sorted, behind a small filter on the top bits."""

    keys: np.ndarray
    values: np.ndarray
    gate: np.ndarray

    @classmethod
    def of(cls, keys, values) -> Table:
        keys, values = np.asarray(keys, dtype=np.uint64), np.asarray(values, dtype=np.float64)
        order = np.argsort(keys)
        gate = np.zeros(1 << 16, dtype=bool)
        gate[(keys >> np.uint64(48)).astype(np.int64)] = True
        return cls(keys[order], values[order], gate)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of listed tokens, and their scores."""
        at = np.flatnonzero(self.gate[(h >> np.uint64(48)).astype(np.int64)])
        if not len(at):
            return at, np.zeros(0)
        own = h[at]
        k = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        hit = self.keys[k] == own
        return at[hit], self.values[k[hit]]


def segments(place: np.ndarray, score: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last token, score), by the linear scan of Ruzzo and Tompa.

    Only the tokens with a positive score are listed, by ``place``; every other
    token scores ``other`` (below 0), which enters the cumulative sums alone.
    """
    left = np.concatenate([[0.0], np.cumsum(score)[:-1]]) + other * (place - np.arange(len(place)))
    right = left + score
    found: list[tuple[float, float, int, int]] = []
    for k in range(len(place)):
        lo, hi, first, last = float(left[k]), float(right[k]), int(place[k]), int(place[k])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= lo:
                j -= 1
            if j < 0 or found[j][1] >= hi:
                found.append((lo, hi, first, last))
                break
            lo, first = found[j][0], found[j][2]
            del found[j:]
    return [(first, last, hi - lo) for lo, hi, first, last in found]


@dataclass
class Model:
    word: Table
    heads: tuple[Table, ...]
    known: Table
    other: float
    rate: float
    size: float
    slope: float = 1.0
    shift: float = 0.0

    def token_scores(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the tokens that speak for toxicity."""
        out = np.zeros(len(w.hashes))
        for table, h in reversed([*zip(self.heads, w.heads, strict=True)]):
            at, value = table.find(h)
            out[at] = value  # longer heads are written later
        at, _ = self.known.find(w.hashes)
        out[at] = 0
        at, value = self.word.find(w.hashes)
        out[at] = value
        at = np.flatnonzero(out > 0)
        return at, out[at]

    def evidence(self, score: float, n: int) -> float:
        """-ln E of a segment of that score in n tokens."""
        return self.rate * score - np.log(self.size * max(n, 1))

    def read(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per row the summed evidence and the significant passages (byte start, end, -ln E)."""
        n = len(offsets) - 1
        w = words(raw, offsets, NOT_ALNUM, HEADS)
        count = np.bincount(w.row, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)])
        at, value = self.token_scores(w)
        edge = np.searchsorted(at, first)
        total, passages = -np.log(self.size * np.maximum(count, 1)), []
        for r in range(n):
            a, b = edge[r], edge[r + 1]
            own: list[tuple[int, int, float]] = []
            if b > a:
                got = [(f, t, self.evidence(s, count[r])) for f, t, s in segments(at[a:b] - first[r], value[a:b], self.other)]
                good = [(int(w.start[first[r] + f] - offsets[r]), int(w.end[first[r] + t] - offsets[r]), float(e)) for f, t, e in got if e > 0]
                own = good
                total[r] = sum(e for *_, e in good) if good else max(e for *_, e in got)
            passages.append(own)
        return np.clip(total, -12, 60), passages

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -40, 40)))


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratios with an informative Dirichlet prior, and the root of the likelihood ratio.

    The root is a z-score that stays sound where one count is 0.
    """
    prior = PRIOR * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n_toxic + PRIOR - a)) - np.log(b / (n_clean + PRIOR - b))
    share = (toxic + clean) / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = toxic * np.log(toxic / (share * n_toxic)) + np.where(clean > 0, clean * np.log(clean / (share * n_clean)), 0.0)
    return odds, np.sqrt(2 * np.maximum(g, 0))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature, smoothed targets, by Newton's steps."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((p - t) * x).sum() + 0.01 * a, (p - t).sum()])
        d = p * (1 - p) + 1e-9
        h = np.array([[(d * x * x).sum() + 0.01, (d * x).sum()], [(d * x).sum(), d.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, train_on, per_class: int = 4000, seed: str = "toxicity") -> Model | float:
    """Learn ``labels.toxic`` from the rows where ``train_on`` holds.

    About ``per_class`` rows a class, chosen by hash: three quarters for the
    lexicon, a quarter for the curve.  A token counts once for each pair of
    neighbours that it is found between, so copies of a text count as one.  What comes to
    the driver is the significant part of the sample's vocabulary and one number
    a text of the quarter.  With one class or no rows: a constant probability.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(train_on)
    sample = per_label(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", "doc_id", per_class, seed)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = materialize(joined.withColumn("part", hash_rate(F.col("doc_id"), f"{seed}-part") < 0.75), "toxicity-sample")
    shares = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 0))
    columns = ["word", *[f"head{k}" for k in HEADS], "place", "toxic", "clean"]
    schema = pa.schema([(c, pa.int64()) for c in columns])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("toxic").cast(pa.int64()).to_numpy()
            for lo, _, raw, offsets in blocks(batch.column("text")):
                w = words(raw, offsets, NOT_ALNUM, HEADS)
                if not len(w.hashes):
                    continue
                start = np.append(True, w.row[1:] != w.row[:-1])
                before = np.where(start, np.uint64(0), np.roll(w.hashes, 1))
                after = np.where(np.roll(start, -1), np.uint64(0), np.roll(w.hashes, -1))
                place = mix(mix(before * np.uint64(3) + w.hashes) + after)
                bad = y[lo + w.row]
                _, once = np.unique(place ^ bad.astype(np.uint64), return_index=True)
                heads = [x[once].astype(np.int64) for x in w.heads]
                yield record_batch(schema, [w.hashes[once].astype(np.int64), *heads, place[once].astype(np.int64), bad[once], 1 - bad[once]])

    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    counted = rows.filter("part").select("text", "toxic").mapInArrow(count, ", ".join(f"{c} long" for c in columns))
    each = counted.groupBy(*columns[:-2]).agg(F.max("toxic").alias("toxic"), F.max("clean").alias("clean"))
    vocabulary = materialize(each.groupBy(*columns[:-3]).agg(*sums), "toxicity-words")
    totals = vocabulary.agg(*sums).first()
    if not totals["toxic"] or not totals["clean"]:
        return shares[1] / sum(shares.values())
    n_toxic, n_clean = float(totals["toxic"]), float(totals["clean"])

    def listed(table: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        got = table.filter(F.col("toxic") >= LEAST_SEEN).filter(F.col("toxic") * n_clean > F.col("clean") * n_toxic).select(key, "toxic", "clean").toPandas()
        odds, z = _log_odds(got["toxic"].to_numpy(float), got["clean"].to_numpy(float), n_toxic, n_clean)
        good = (z >= LEAST_Z) & (odds >= LEAST_ODDS)
        return got[key].to_numpy(np.int64)[good].astype(np.uint64), odds[good], got["toxic"].to_numpy(float)[good], got["clean"].to_numpy(float)[good]

    keys, odds, toxic, clean = listed(vocabulary, "word")
    heads, kinds = [], []
    for k in HEADS:
        name = f"head{k}"
        its, strength, *_ = listed(vocabulary.filter(F.col(name) != 0).groupBy(name).agg(*sums), name)
        heads.append(Table.of(its, strength))
        kinds.append(its)
    # Words that are known well and not toxic, though they begin like one that is.
    begins = [F.col(f"head{k}").isin([int(x) for x in its.astype(np.int64)]) for k, its in zip(HEADS, kinds, strict=True) if len(its)]
    safe = np.zeros(0, np.uint64)
    if begins:
        like = begins[0]
        for other in begins[1:]:
            like |= other
        got = vocabulary.filter(like & (F.col("clean") >= 2) & (F.col("clean") * n_toxic >= F.col("toxic") * n_clean)).select("word").toPandas()
        safe = got["word"].to_numpy(np.int64).astype(np.uint64)
    # One class of all other tokens: its log-odds, a little below 0, is what a token costs a segment.
    p1, p0 = toxic.sum() / n_toxic, (clean.sum() + 0.5) / n_clean
    other = min(float(np.log((1 - p1) / (1 - p0))), -0.02)
    chance = (clean + PRIOR * (toxic + clean) / (n_toxic + n_clean)) / (n_clean + PRIOR)
    rate = _lambda(odds, chance, other) if len(odds) else 1.0
    model = Model(Table.of(keys, odds), tuple(heads), Table.of(safe, np.zeros(len(safe))), other, rate, 0.1)
    curve_schema = pa.schema([("toxic", pa.int64()), ("evidence", pa.float64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column("text")):
                yield record_batch(curve_schema, [batch.column("toxic").cast(pa.int64())[lo:hi], model.read(raw, offsets)[0]])

    rest = rows.filter(~F.col("part")).select("text", "toxic").mapInArrow(weigh, "toxic long, evidence double").toPandas()
    y, x = rest["toxic"].to_numpy(float), rest["evidence"].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        model.slope, model.shift = _curve(x, y)
    return model


def _lambda(odds: np.ndarray, chance: np.ndarray, other: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over a clean text's tokens."""
    rest = max(1 - chance.sum(), 1e-6)
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if (chance * np.exp(mid * odds)).sum() + rest * np.exp(mid * other) > 1:
            hi = mid
        else:
            lo = mid
    return lo


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """Add ``score`` double (0 to 1) and ``passages`` array<struct<start, end, evidence>> to every row.

    Offsets are code points of the text, half-open.  Null and empty texts score
    as a text without tokens and have no passage; repeated rows stay; input
    columns of these names are replaced.
    """
    require(docs, "text")
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "passages")])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def points(raw: np.ndarray, spans: list[tuple[int, int, float]]) -> list[dict]:
        if not spans:
            return []
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return [{"start": int(lead[a]), "end": int(lead[b]), "evidence": e} for a, b, e in spans]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = np.full(batch.num_rows, model if isinstance(model, float) else 0.0), [[] for _ in range(batch.num_rows)]
            if not isinstance(model, float):
                for lo, hi, raw, offsets in blocks(batch.column("text")):
                    evidence, found = model.read(raw, offsets)
                    out[lo:hi] = model.probability(evidence)
                    spans[lo:hi] = [points(raw[offsets[r] : offsets[r + 1]], f) for r, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array(spans, kind)], names=[*batch.schema.names, "score", "passages"])

    return kept.mapInArrow(rate, extended(kept, "score double, passages array<struct<start:long,end:long,evidence:double>>"))


def op10_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted; crc32(doc_id) mod 5 = 0 is held out of training."""
    require(docs, "doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, ~out, per_class))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
