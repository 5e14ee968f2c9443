"""Evaluation of annotations: aggregates over rows of counts, audits, usage, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from marginalia.functions.spans import f1, precision, recall


def micro_macro(rows: DataFrame, *by: str, empty: float = 1.0) -> DataFrame:
    """Micro scores from summed tp, fp, fn, and the mean of the rows' own scores, of each group.

    ``empty`` is what precision and recall are where their denominator is zero.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    sums = [F.sum(c) for c in ("tp", "fp", "fn")]
    each = {"precision": precision(tp, fp, empty), "recall": recall(tp, fn, empty), "f1": f1(tp, fp, fn, empty)}
    out = rows.groupBy(*by).agg(*[s.alias(n) for s, n in zip(sums, ("tp", "fp", "fn"), strict=True)], *[F.avg(c).alias(f"macro_{n}") for n, c in each.items()])
    micro = {f"micro_{n}": F.round(c, 6) for n, c in each.items()}
    return out.select("*", *[c.alias(n) for n, c in micro.items()]).withColumns({f"macro_{n}": F.round(f"macro_{n}", 6) for n in each})


def by_facet(rows: DataFrame, facet: str, least: int = 15) -> DataFrame:
    """Micro scores of (tp, fp, fn) by a facet; null is ``unknown``; facets of fewer than ``least`` references are not reported."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    sums = rows.groupBy(F.coalesce(F.col(facet), F.lit("unknown")).alias(facet)).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    scored = {"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)}
    return sums.filter(tp + fn >= least).withColumns({n: F.round(c, 4) for n, c in scored.items()})


def multilabel(rows: DataFrame, reference: str, predicted: str, *by: str) -> DataFrame:
    """n, exact_set, tp, fp, fn, micro_f1 of sets of labels given as arrays; null is the empty set, repeats count once."""
    empty = F.array().cast("array<string>")
    r, p = (F.array_distinct(F.coalesce(F.col(c), empty)) for c in (reference, predicted))
    each = rows.select(*by, F.size(F.array_intersect(r, p)).alias("tp"), F.size(F.array_except(p, r)).alias("fp"), F.size(F.array_except(r, p)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    exact = F.avg(((fp == 0) & (fn == 0)).cast("double"))
    sums = each.groupBy(*by).agg(F.count("*").alias("n"), F.round(exact, 6).alias("exact_set"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumn("micro_f1", F.round(f1(tp, fp, fn), 6))


def majority_accuracy(votes: DataFrame, gold: DataFrame, n_voters: int) -> DataFrame:
    """items, accuracy of the majority label; without a majority of all voters the answer is REJECT.

    votes: item, voter, label; gold: item, gold.
    """
    counts = votes.groupBy("item", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("item").agg(F.max("n").alias("n"), F.max_by("label", "n").alias("label"))
    answer = F.when(F.col("n") > n_voters / 2, F.col("label")).otherwise("REJECT")
    met = best.join(gold, "item").select((answer == F.col("gold")).cast("double").alias("hit"))
    return met.agg(F.count("*").alias("items"), F.round(F.avg("hit"), 6).alias("accuracy"))


def extremes(pairs: DataFrame) -> DataFrame:
    """kind (most, least), voter_a, voter_b, agreement: the pairs that agree most and least; ties to the lesser pair."""
    most = F.struct((-F.col("agreement")).alias("k"), "voter_a", "voter_b")
    least = F.struct(F.col("agreement").alias("k"), "voter_a", "voter_b")
    found = pairs.agg(F.min(most).alias("most"), F.min(least).alias("least"))
    rows = found.select(F.explode(F.array(F.struct(F.lit("most").alias("kind"), F.col("most").alias("p")), F.struct(F.lit("least").alias("kind"), F.col("least").alias("p")))).alias("x"))
    rows = rows.select("x.kind", "x.p.voter_a", "x.p.voter_b", F.abs("x.p.k").alias("agreement"))
    return rows.filter(F.col("voter_a").isNotNull())


def supported(rows: DataFrame, by: str, label: str, labels: list[str]) -> DataFrame:
    """reference_total, supported and ceiling: the share of references whose label a method can give at all."""
    inside = F.coalesce(F.col(label).isin(labels), F.lit(False))
    out = rows.groupBy(by).agg(F.count("*").alias("reference_total"), F.count_if(inside).alias("supported"))
    return out.withColumn("ceiling", F.round(F.try_divide(F.col("supported").cast("double"), "reference_total"), 6))


def audit_rates(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """The share of rows that each flag holds for; a null flag does not hold."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(f"{n}_rate") for n, c in flags.items()])


def correction_burden(reviews: DataFrame, key: str, action: str) -> DataFrame:
    """records_reviewed, records_corrected: an edit or a rejection corrects, an acceptance only reviews."""
    of = reviews.groupBy(key).agg(F.max(F.col(action).isin("accept", "edit", "reject")).alias("seen"), F.max(F.col(action).isin("edit", "reject")).alias("changed"))
    return of.agg(F.count_if("seen").alias("records_reviewed"), F.count_if("changed").alias("records_corrected"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Dollars at prices a million tokens; null where a count is."""
    return F.round(tokens_in * (price_in / 1e6) + tokens_out * (price_out / 1e6), 6)


def token_role_scores(tokens: DataFrame, gold: str, predicted: str, outside: str = "O", ignored: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over token roles other than ``outside``; one where there is nothing."""
    rows = tokens if ignored is None else tokens.filter(~F.col(gold).eqNullSafe(F.lit(ignored)))
    g, p = F.col(gold), F.col(predicted)
    counts = rows.agg(
        F.count_if((g == p) & (g != outside)).alias("tp"), F.count_if((p != outside) & (g != p)).alias("fp"), F.count_if((g != outside) & (g != p)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", F.round(precision(tp, fp, 1.0), 6).alias("precision"), F.round(recall(tp, fn, 1.0), 6).alias("recall"), F.round(f1(tp, fp, fn, 1.0), 6).alias("f1"))


def prediction_status(records: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """key, status of the ids of both sides: ok, missing, unknown, or changed where the text's hash differs.

    records: key, text; predictions: key, source_sha256.
    """
    left = records.select(key, F.sha2("text", 256).alias("own"), F.lit(True).alias("here"))
    right = predictions.select(key, "source_sha256", F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "unknown").when(F.col("own").eqNullSafe(F.col("source_sha256")), "ok").otherwise("changed")
    return left.join(right, key, "full").select(key, status.alias("status"))


def gate(rows: DataFrame, marker: Column, what: str) -> DataFrame:
    """The rows themselves; reading one that ``marker`` holds for fails with ``what``."""
    return rows.withColumn("__ok", F.when(marker, F.raise_error(F.lit(what))).otherwise(F.lit(True))).filter("__ok").drop("__ok")


def holdout_split(rows: DataFrame, by: str, order: str, of: int = 15, last: int = 3) -> DataFrame:
    """split (train, dev): of every ``of`` rows of a category in order, the ``last`` are for development.

    A row's place is its place in its bucket of the category (cut at 255
    quantiles of a numeric ``order``) plus the sizes of the buckets before, so a
    category that holds most rows is not sorted in one task.  An order that is
    no number has one bucket.  Null categories are one category; a null order
    comes first.
    """
    bucket = F.lit(0)
    if isinstance(rows.schema[order].dataType, NumericType):
        cuts = rows.groupBy(F.col(by).alias("__by")).agg(F.percentile_approx(order, [i / 256 for i in range(1, 256)], 2560).alias("__cuts"))
        rows = rows.join(cuts, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
        bucket = F.coalesce(F.size(F.filter(F.col("__cuts"), lambda x: x < F.col(order))), F.lit(0))
    placed = rows.withColumn("__bucket", bucket).drop("__cuts")
    sizes = placed.groupBy(F.col(by).alias("__by"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__by").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows a category at most
    bases = sizes.select("__by", "__b", F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(order)) - 1
    met = placed.withColumn("__own", own).join(bases, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__bucket") == F.col("__b")))
    place = F.col("__base") + F.col("__own")
    return met.withColumn("split", F.when(place % of >= of - last, "dev").otherwise("train")).drop("__by", "__b", "__bucket", "__base", "__own")


def queue(items: DataFrame, key: str, unanimous: str, sample: int = 40, seed: str = "2026") -> DataFrame:
    """key, stratum: every contested item (B) and a hash sample of ``sample`` unanimous ones (A)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    a = items.filter(unanimous).select(key).orderBy(order, key).limit(sample).withColumn("stratum", F.lit("A"))
    return a.unionByName(items.filter(~F.col(unanimous)).select(key).withColumn("stratum", F.lit("B")))
