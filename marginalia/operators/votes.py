"""Agreement and aggregation of votes: long tables (item, voter, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.scratch import materialize

ABSTAIN, REJECT = "NONE", "REJECT"


def profile(votes: DataFrame) -> DataFrame:
    """item, n_votes, n_labels, modal_label, agreement, unanimous; ties go to the lesser label."""
    counts = votes.groupBy("item", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("item").agg(F.max(F.struct("n", F.col("label"))).alias("any"), F.sum("n").alias("n_votes"), F.count("*").alias("n_labels"), F.max("n").alias("agreement"))
    tied = counts.join(best, "item").filter(F.col("n") == F.col("agreement")).groupBy("item", "n_votes", "n_labels", "agreement").agg(F.min("label").alias("modal_label"))
    return tied.select("item", "n_votes", "n_labels", "modal_label", "agreement", (F.col("n_labels") == 1).alias("unanimous"))


def pairwise(votes: DataFrame) -> DataFrame:
    """Share of equal labels on shared items for each pair of voters.

    Counts per (item, label) pattern of voters would not bound pairs; an item
    has at most one vote a voter, so its pairs are bounded by the voters' number.
    """
    a, b = votes.alias("a"), votes.alias("b")
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.voter") < F.col("b.voter")))
    agreed = F.avg((F.col("a.label") == F.col("b.label")).cast("double"))
    return met.groupBy(F.col("a.voter").alias("voter_a"), F.col("b.voter").alias("voter_b")).agg(F.count("*").alias("shared"), agreed.alias("agreement"))


def unanimity(votes: DataFrame) -> DataFrame:
    """Among items with a vote of every voter, the share with one label."""
    voters = votes.select("voter").distinct().agg(F.count("*").alias("all_voters"))
    items = votes.groupBy("item").agg(F.count_distinct("voter").alias("n"), F.count_distinct("label").alias("k"))
    full = items.join(F.broadcast(voters), F.col("n") == F.col("all_voters"))
    return full.agg(F.count("*").alias("items"), F.avg((F.col("k") == 1).cast("double")).alias("rate"))


def krippendorff(votes: DataFrame) -> DataFrame:
    """Nominal alpha from label counts per item; no pairs are built.

    Agreeing ordered pairs of an item are sum n_c (n_c - 1), weighed 1/(m - 1).
    """
    per = votes.groupBy("item", "label").agg(F.count("*").alias("n"))
    m = Window.partitionBy("item")
    per = per.withColumn("m", F.sum("n").over(m)).filter(F.col("m") > 1)
    agree = per.agg(F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("agree"), F.sum("n").alias("total"))
    margins = per.groupBy("label").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("chance"))
    both = agree.crossJoin(margins)  # one row each
    observed = 1 - F.col("agree") / F.col("total")
    expected = 1 - F.col("chance") / (F.col("total") * (F.col("total") - 1))
    alpha = 1 - F.try_divide(observed, expected)
    return both.select(F.col("total").cast("long").alias("n_labels"), F.round(alpha, 6).alias("alpha"))


def calibration(items: DataFrame, n_voters: int) -> DataFrame:
    """For each agreement k: precision and coverage of accepting items with agreement >= k."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(n_voters))).alias("k")
    rows = items.select("agreement", "correct").select("*", ks)
    hit = F.col("agreement") >= F.col("k")
    out = rows.groupBy("k").agg(F.count_if(hit).alias("n_auto"), F.count_if(hit & F.col("correct")).alias("good"), F.count("*").alias("total"))
    return out.select("k", "n_auto", F.round(F.try_divide(F.col("good").cast("double"), F.col("n_auto")), 6).alias("precision"), F.round(F.col("n_auto").cast("double") / F.col("total"), 6).alias("coverage"), (F.col("total") - F.col("n_auto")).alias("burden"))


class _Model:
    """The two steps of the estimation over a block of vote patterns."""

    def __init__(self, labels: list[str], n_voters: int, reject_weight: float):
        self.seen, self.n_latent, self.n_voters, self.reject_weight = [*labels, ABSTAIN], len(labels) + 1, n_voters, reject_weight
        self.at = {x: i for i, x in enumerate(self.seen)}

    def votes(self, patterns) -> np.ndarray:
        """One-hot pattern x voter x vote."""
        code = np.array([[self.at[x] for x in p.split("|")] for p in patterns]).reshape(-1, self.n_voters)
        return np.eye(len(self.seen))[code]

    def expect(self, votes: np.ndarray, parameters: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and log-likelihoods; without parameters, the votes' shares to begin with."""
        if parameters is None:
            start = votes.sum(1)
            post = np.hstack([start[:, :-1], 0.5 * start[:, -1:]]) + 1e-6
            return post / post.sum(1, keepdims=True), np.zeros(len(votes))
        prior, table = parameters
        log = np.log(prior)[None] + np.einsum("pvo,vlo->pl", votes, np.log(table))
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        return np.exp(log - total[:, None]), total

    def sums(self, votes: np.ndarray, n: np.ndarray, parameters) -> np.ndarray:
        """Log-likelihood, weight of each latent label, and weight of voter x latent x vote, in one flat array."""
        post, total = self.expect(votes, parameters)
        weight = post * n[:, None]
        return np.concatenate([[total @ n], weight.sum(0), np.einsum("pl,pvo->vlo", weight, votes).ravel()])

    def maximise(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prior = sums[1 : 1 + self.n_latent] + 1e-9
        table = sums[1 + self.n_latent :].reshape(self.n_voters, self.n_latent, len(self.seen)) + 1e-9
        table[:, -1, -1] += self.reject_weight
        table[:, -1, :-1] += 0.02 * self.reject_weight
        return prior / prior.sum(), table / table.sum(2, keepdims=True)


def dawid_skene(votes: DataFrame, labels: list[str], voters: list[str], rounds: int = 200, tolerance: float = 1e-7, reject_weight: float = 50.0, most: int = 100_000) -> DataFrame:
    """item, latent, posterior by expectation-maximisation over vote patterns.

    Items with the same votes have the same posterior, so the iteration works on
    the distinct patterns and their counts, and posteriors are joined back.  Up
    to ``most`` patterns are kept on the driver; where there are more they stay
    in a written table, and of each round only sums of voters x labels squared
    reach the driver.  The steps are the same.  Without votes there are no rows.
    """
    known = F.when(F.col("label").isin(labels), F.col("label")).otherwise(ABSTAIN)
    wide = votes.withColumn("label", known).groupBy("item").pivot("voter", voters).agg(F.min("label")).na.fill(ABSTAIN, voters)
    wide = wide.withColumn("pattern", F.concat_ws("|", *[F.col(f"`{v}`") for v in voters]))
    model, latent = _Model(labels, len(voters), reject_weight), [*labels, REJECT]
    counted = wide.groupBy("pattern").agg(F.count("*").alias("n"))
    few = counted.limit(most + 1).toPandas().sort_values("pattern")
    if not len(few):
        return wide.select("item", F.lit(None).cast("string").alias("latent"), F.lit(None).cast("double").alias("posterior"))
    if len(few) <= most:
        held, n = model.votes(few["pattern"]), few["n"].to_numpy(float)
        step = lambda parameters: model.sums(held, n, parameters)
    else:
        counted = materialize(counted, "vote-patterns")

        def step(parameters):
            def partial(blocks):
                total = None
                for block in blocks:
                    own = model.sums(model.votes(block["pattern"]), block["n"].to_numpy(float), parameters)
                    total = own if total is None else total + own
                if total is not None:
                    yield pd.DataFrame({"sums": [total.tolist()]})

            return np.sum([r["sums"] for r in counted.mapInPandas(partial, "sums array<double>").collect()], axis=0)

    sums, last, parameters = step(None), -np.inf, None
    for _ in range(rounds):
        parameters = model.maximise(sums)
        sums = step(parameters)
        if abs(sums[0] - last) < tolerance:
            break
        last = sums[0]

    def scored(blocks):
        for block in blocks:
            post, _ = model.expect(model.votes(block["pattern"]), parameters)
            yield pd.DataFrame({"pattern": np.repeat(block["pattern"].to_numpy(), len(latent)), "latent": latent * len(block), "posterior": post.ravel()})

    schema = "pattern string, latent string, posterior double"
    found = votes.sparkSession.createDataFrame(next(scored([few])), schema) if len(few) <= most else counted.mapInPandas(scored, schema)
    return wide.select("item", "pattern").join(found, "pattern").select("item", "latent", "posterior")


def reliability(votes: DataFrame, posteriors: DataFrame, labels: list[str]) -> DataFrame:
    """voter, accuracy (how often right where a label was given), coverage (how often one was given).

    Both are means over the latent labels, weighed within each by the posterior
    of :func:`dawid_skene`; accuracy skips labels the voter never spoke on, and
    is null where it spoke on none.  Votes outside ``labels`` are abstentions.
    """
    real = posteriors.filter(F.col("latent").isin(labels))
    mass = real.groupBy("latent").agg(F.sum("posterior").alias("mass"))  # a row a label
    spoke = F.sum(F.when(F.col("label").isin(labels), F.col("posterior")).otherwise(0.0))
    right = F.sum(F.when(F.col("label") == F.col("latent"), F.col("posterior")).otherwise(0.0))
    per = votes.join(real, "item").groupBy("voter", "latent").agg(spoke.alias("spoke"), right.alias("right")).join(F.broadcast(mass), "latent")
    accuracy = F.avg(F.when(F.col("spoke") > 1e-12, F.col("right") / F.col("spoke")))
    coverage = F.sum(F.try_divide("spoke", "mass")) / len(labels)
    return per.groupBy("voter").agg(F.round(accuracy, 6).alias("accuracy"), F.round(coverage, 6).alias("coverage"))


def bootstrap_f1(counts: DataFrame, by: str, replicates: int = 1000, seed: int = 2026) -> DataFrame:
    """Percentile interval of F1 over resampled passages.

    Passages with equal (tp, fp, fn) are one kind; each replicate draws kinds by
    a multinomial over their counts, so the state is the number of kinds.
    """
    kinds = counts.groupBy(by, "tp", "fp", "fn").agg(F.count("*").alias("n"))

    def resample(key, rows):
        n = rows["n"].to_numpy()
        draws = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=replicates)
        tp, fp, fn = (draws @ rows[c].to_numpy(float) for c in ("tp", "fp", "fn"))
        f1 = np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)
        lo, hi = np.quantile(f1, [0.025, 0.975])
        return pd.DataFrame({by: [key[0]], "low": [lo], "high": [hi]})

    kind = counts.schema[by].dataType.simpleString()
    return kinds.groupBy(by).applyInPandas(resample, f"{by} {kind}, low double, high double")


def entity_vote(spans: DataFrame, n_models: int, threshold: float = 0.5) -> DataFrame:
    """Votes on exact (span, label) with the share of models and a review flag."""
    out = spans.groupBy("pid", "start", "end", "label").agg(F.count_distinct("voter").alias("vote_count"))
    ratio = F.col("vote_count") / F.lit(float(n_models))
    return out.withColumn("vote_ratio", ratio).withColumn("requires_review", F.col("vote_ratio") < threshold)
