"""Panels that label whole segments: abstentions, agreement reports, affect scores, rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.spans import f1, precision, recall
from marginalia.operators import votes as V

NEGATIVE = ("fear", "anger", "sadness", "disgust")
POSITIVE = ("joy", "hope", "love", "trust", "gratitude", "relief")


def polarity(emotion: Column, negative: tuple[str, ...] = NEGATIVE, positive: tuple[str, ...] = POSITIVE) -> Column:
    """The sentiment that an emotion goes with: negative, positive, else neutral; null stays null."""
    return F.when(emotion.isNull(), None).when(emotion.isin(*negative), "negative").when(emotion.isin(*positive), "positive").otherwise("neutral")


def with_abstentions(votes: DataFrame, voters: list[str]) -> DataFrame:
    """item, voter, label of every item and voter; who said nothing abstains."""
    every = votes.select("item").distinct().select("item", F.explode(F.array(*[F.lit(v) for v in voters])).alias("voter"))
    return every.join(votes, ["item", "voter"], "left").select("item", "voter", F.coalesce("label", F.lit(V.ABSTAIN)).alias("label"))


def distribution(votes: DataFrame, label: str = "label") -> DataFrame:
    """label, n, rank from the commonest; ties by label."""
    counted = votes.groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), label)))  # a row a label


def report(votes: DataFrame, labels: list[str], voters: list[str]) -> DataFrame:
    """metric, key, value of a panel: alpha, unanimity, agreement of pairs, counts of labels, accuracy of voters without gold."""
    named = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    posteriors = V.dawid_skene(votes, labels, voters)
    parts = [
        named(V.krippendorff(votes.filter(F.col("label").isin(labels))), "alpha", none, F.col("alpha")),
        named(V.unanimity(votes), "unanimity", none, F.col("rate")),
        named(V.pairwise(votes), "agreement", F.concat_ws("|", "voter_a", "voter_b"), F.round("agreement", 4)),
        named(distribution(votes), "label", F.col("label"), F.col("n")),
        named(V.reliability(votes, posteriors, labels), "accuracy", F.col("voter").cast("string"), F.round("accuracy", 4)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def consensus(posteriors: DataFrame) -> DataFrame:
    """item, latent: the likeliest label; ties to the lesser."""
    best = F.min_by("latent", F.struct((-F.col("posterior")).alias("p"), "latent"))
    return posteriors.groupBy("item").agg(best.alias("latent"))


def label_scores(pairs: DataFrame, labels: list[str], reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of each of ``labels``, those that never occur too; null predicts nothing."""
    r, p = F.col(reference), F.col(predicted)
    long = pairs.select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), r.alias("r"), p.alias("p"))
    hit_r, hit_p = F.coalesce(F.col("r") == F.col("label"), F.lit(False)), F.coalesce(F.col("p") == F.col("label"), F.lit(False))
    sums = long.groupBy("label").agg(F.count_if(hit_r & hit_p).alias("tp"), F.count_if(hit_p & ~hit_r).alias("fp"), F.count_if(hit_r & ~hit_p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("*", F.round(precision(tp, fp), 6).alias("precision"), F.round(recall(tp, fn), 6).alias("recall"), F.round(f1(tp, fp, fn), 6).alias("f1"))


def sentiment_scores(pairs: DataFrame, labels: list[str], reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """n, accuracy and the mean F1 over ``labels``; the pairs are read once."""
    r, p = F.col(reference), F.col(predicted)
    sums = [F.count("*").alias("n"), F.count_if(F.coalesce(r == p, F.lit(False))).alias("right")]
    for k, x in enumerate(labels):
        hit_r, hit_p = F.coalesce(r == x, F.lit(False)), F.coalesce(p == x, F.lit(False))
        sums += [F.count_if(hit_r & hit_p).alias(f"tp{k}"), F.count_if(hit_p & ~hit_r).alias(f"fp{k}"), F.count_if(hit_r & ~hit_p).alias(f"fn{k}")]
    each = [F.round(f1(*[F.col(f"{c}{k}") for c in ("tp", "fp", "fn")]), 6) for k in range(len(labels))]
    mean = F.round(sum(each[1:], each[0]) / len(labels), 6)
    return pairs.agg(*sums).select("n", F.round(F.try_divide(F.col("right").cast("double"), "n"), 6).alias("accuracy"), mean.alias("macro_f1"))


def grounding(predictions: DataFrame, passages: DataFrame, key: str = "item") -> DataFrame:
    """stated, grounded, rate of evidence quotes; a prediction without a quote counts in none, and without any the rate is null."""
    met = predictions.join(passages.select(key, F.col("text").alias("__text")), key, "left")
    stated = F.coalesce(F.length("evidence_quote"), F.lit(0)) > 0
    held = stated & F.coalesce(F.contains("__text", "evidence_quote"), F.lit(False))
    out = met.agg(F.count_if(stated).alias("stated"), F.count_if(held).alias("grounded"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("grounded").cast("double"), "stated"), 6))


def trajectory(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """Each narrative's segments in order: step (from 0), value, and the mean of the values so far."""
    past = Window.partitionBy(by).orderBy(order)
    kept = rows.select(by, order, value.cast("double").alias("value"))
    return kept.select(by, order, (F.row_number().over(past) - 1).alias("step"), "value", F.round(F.avg("value").over(past.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("so_far"))


def leading(scored: DataFrame, name: str = "voter") -> DataFrame:
    """first, second, overlapping: the two best by f1 (ties by name) and whether their intervals (low, high) overlap.

    Overlapping intervals are no ranking.  One row, or none where there are fewer than two.
    """
    best = scored.orderBy(F.desc("f1"), name).limit(2)
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("f1")).alias("k"), F.col(name).alias("name"), "low", "high"))).alias("x")).filter(F.size("x") == 2)
    a, b = F.col("x")[0], F.col("x")[1]
    return rows.select(a["name"].alias("first"), b["name"].alias("second"), (a["low"] <= b["high"]).alias("overlapping"))


_SPLIT = np.uint64(0x9E3779B97F4A7C15)
#: Distribution of a Poisson count of mean one, up to what a double can tell.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 18)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_mean(rows: DataFrame, by: str, key: str, value: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 2026) -> DataFrame:
    """by, mean, low, high: percentile interval of a mean, resampled without gathering a group.

    Each row counts as often as a Poisson draw of mean one, made from its key's
    hash, says in each replicate; replicates are then sums, combined wherever
    they are.  The same on every run and partitioning.  Null values are left out.
    """
    kept = rows.filter(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v"))
    kind = rows.schema[by].dataType.simpleString()
    step = np.arange(replicates, dtype=np.uint64) * _SPLIT

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            group = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
            h, v = batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy()
            for g in np.unique(group):
                n, total = np.zeros(replicates), np.zeros(replicates)
                own = np.flatnonzero(group == g)
                for lo in range(0, len(own), 1024):
                    at = own[lo : lo + 1024]
                    draw = np.searchsorted(_POISSON, _mixed(h[at][:, None] + step[None]) / 2.0**64, side="right").astype(np.float64)
                    n += draw.sum(0)
                    total += v[at] @ draw
                name = pa.nulls(replicates, names.dictionary.type) if g == len(names.dictionary) else pa.array([names.dictionary[int(g)].as_py()] * replicates, names.dictionary.type)
                yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(replicates, dtype=np.int32)), pa.array(n), pa.array(total)], names=["by", "b", "n", "total"])

    drawn = kept.mapInArrow(resample, f"by {kind}, b int, n double, total double").groupBy("by", "b").agg((F.sum("total") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    interval = F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    ends = drawn.filter(F.col("n") > 0).groupBy("by").agg(interval.alias("x"))
    means = kept.groupBy("by").agg(F.avg("v").alias("mean"))
    met = means.join(ends.select(F.col("by").alias("of"), "x"), F.col("by").eqNullSafe(F.col("of")))
    return met.select(F.col("by").alias(by), "mean", F.col("x")[0].alias("low"), F.col("x")[1].alias("high"))
