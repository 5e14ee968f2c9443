"""Record operators: deduplication, sampling, turns, field scores, reviews, telemetry, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import SPACE, dedupe_key


def first_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """One row a key, the first by ``order``.

    The winner's place is a map-side combined minimum; no key is sorted, so a
    key with very many rows is no hot spot.
    """
    keyed = rows.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    return keyed.join(first.select(F.col("__key").alias("__k"), "__first"), (F.col("__key") == F.col("__k")) & (F.col(order) == F.col("__first"))).drop("__key", "__k", "__first")


def dedupe_texts(passages: DataFrame, order: str) -> DataFrame:
    return first_wins(passages, F.md5(dedupe_key(F.col("text")).cast("binary")), order)


def hash_order(seed: str, key: Column) -> Column:
    """A portable pseudo-random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "2026") -> DataFrame:
    """A repeatable sample of ``n`` rows: top-n by hash, which each task cuts to n first."""
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def _levelled(rows: DataFrame, value: str, cut: Column) -> DataFrame:
    """Add ``__less``: what each stratum gives up when ``cut`` units are taken one by one from the largest, the first on ties.

    What is left of each is at most a level; the units that the level does not
    account for stay with the last of those that reach it.
    """
    down = Window.orderBy(F.desc(value), F.desc("stratum")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    v = F.col(value)
    spare = F.floor((F.sum(v).over(down) - cut) / F.count("*").over(down))
    level = F.greatest(F.max(spare).over(every), F.lit(0))
    rows = rows.withColumn("__level", level)
    left = F.sum(F.greatest(v - F.col("__level"), F.lit(0))).over(every) - cut
    rows = rows.withColumn("__left", left)
    above = F.when(v > F.col("__level"), 1)
    keeps = F.sum(F.when(v > F.col("__level"), 1).otherwise(0)).over(Window.orderBy(F.desc("stratum")).rowsBetween(Window.unboundedPreceding, 0)) <= F.col("__left")
    less = F.when(above == 1, v - F.col("__level") - F.when(keeps, 1).otherwise(0)).otherwise(0)
    return rows.withColumn("__less", F.when(cut > 0, less).otherwise(0)).drop("__level", "__left")


def allocate(strata: DataFrame, want: int) -> DataFrame:
    """stratum, size, quota: shares in proportion, one at the least, trimmed or filled to ``want`` exactly.

    What is too much comes off the largest quotas, one unit at a time (a quota
    may fall to none, where there are more strata than ``want``); what lacks goes
    where most is left; ties to the first stratum.  All rows where there are
    fewer than ``want``.  Works on the table of strata, a row each.
    """
    every = Window.partitionBy()
    total = F.sum("size").over(every)
    rows = strata.withColumn("__want", F.least(F.lit(want).cast("long"), total))
    rows = rows.withColumn("quota", F.least(F.greatest(F.lit(1), F.bround(F.col("__want").cast("double") * F.col("size") / total)).cast("long"), F.col("size")))
    rows = rows.withColumn("__gap", F.sum("quota").over(every) - F.col("__want"))
    rows = _levelled(rows, "quota", F.greatest(F.col("__gap"), F.lit(0))).withColumnRenamed("__less", "__cut").withColumn("__slack", F.col("size") - F.col("quota"))
    rows = _levelled(rows, "__slack", F.greatest(-F.col("__gap"), F.lit(0)))
    return rows.select("stratum", "size", (F.col("quota") - F.col("__cut") + F.col("__less")).cast("long").alias("quota"))


def top_by_hash(rows: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: str) -> DataFrame:
    """The first ``quota`` rows of each stratum by hash order; quotas: stratum, quota.

    Every partition cuts its strata to the largest quota before the shuffle.
    """
    most = quotas.agg(F.max("quota").alias("most")).first()["most"] or 0
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)
    ranked = rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= most)
    own = quotas.select(F.col("stratum").alias("__stratum"), F.col("quota").alias("__quota"))
    return ranked.join(own, F.col(stratum).eqNullSafe(F.col("__stratum"))).filter(F.col("__rank") <= F.col("__quota")).drop("__rank", "__quota", "__stratum")


def stratified_sample(rows: DataFrame, stratum: str, key: str, want: int, seed: str = "2026", positive: Column | None = None, negative_share: float = 0.0) -> DataFrame:
    """A proportional sample over strata, members by hash order within each.

    With ``positive``, ``negative_share`` of the sample is drawn from the rows
    where it does not hold, in proportion to their own strata; where there are
    fewer of those, positives fill up.
    """
    if positive is None:
        quotas = allocate(rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("size")), want)
        return top_by_hash(rows, stratum, key, quotas, seed)
    marked = rows.withColumn("__positive", F.coalesce(positive, F.lit(False)))
    sizes = {r["__positive"]: r["n"] for r in marked.groupBy("__positive").agg(F.count("*").alias("n")).collect()}  # two rows
    want = min(want, sum(sizes.values()))
    negative = min(round(want * negative_share), sizes.get(False, 0))
    halves = [stratified_sample(marked.filter(F.col("__positive") == side), stratum, key, n, seed) for side, n in ((True, want - negative), (False, negative))]
    return halves[0].unionByName(halves[1]).drop("__positive")


def simple_sample(rows: DataFrame, stratum: str, key: str, want: int, positive: Column, negative_share: float, seed: str = "2026") -> DataFrame:
    """Positives in proportion to their strata (one each at the least, cut to the number wanted), then negatives at random.

    Nothing is filled up: strata that are too small leave the sample short.
    """
    marked = rows.withColumn("__positive", F.coalesce(positive, F.lit(False)))
    sizes = {r["__positive"]: r["n"] for r in marked.groupBy("__positive").agg(F.count("*").alias("n")).collect()}  # two rows
    negative = min(sizes.get(False, 0), round(want * negative_share))
    wanted, total = want - negative, max(sizes.get(True, 0), 1)
    good = marked.filter("__positive")
    quotas = good.groupBy(F.col(stratum).alias("stratum")).agg(F.greatest(F.lit(1), F.bround(F.lit(float(wanted)) * F.count("*") / F.lit(total))).cast("long").alias("quota"))
    picked = hash_sample(top_by_hash(good, stratum, key, quotas, seed), key, wanted, f"{seed}+")
    return picked.unionByName(hash_sample(marked.filter(~F.col("__positive")), key, negative, seed)).drop("__positive")


def qa_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", asks: str = "user", answers: str = "assistant") -> DataFrame:
    """conversation, pair, question turn, answer turn: each question with the next answer before another question."""
    order = Window.partitionBy(conversation).orderBy(turn)
    asked = F.col(role) == asks
    rows = turns.withColumn("pair", F.sum(asked.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("pair") > 0)
    return rows.groupBy(conversation, "pair").agg(
        F.min(F.when(asked, F.col(turn))).alias("question"), F.min(F.when(F.col(role) == answers, F.col(turn))).alias("answer")
    )


def carry_forward(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Add ``inherited``: the last value stated before the row."""
    past = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inherited", F.last(value, ignorenulls=True).over(past))


def first_eligible(rows: DataFrame, by: str, order: str, count: Column, least: int = 2) -> DataFrame:
    """The first row of each group with ``count`` >= least, else the first with one, else none."""
    marked = rows.withColumn("__n", count)
    chosen = marked.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("__n") >= least, F.col(order))), F.min(F.when(F.col("__n") >= 1, F.col(order)))).alias("chosen"))
    return chosen.filter(F.col("chosen").isNotNull())


def field_scores(pairs: DataFrame, fields: list[str], reference: str = "ref_", prediction: str = "pred_") -> DataFrame:
    """field, correct, missing, unsupported, mismatch, both_missing and the rates over them."""
    rows = ", ".join(f"'{f}', cast({reference}{f} as string), cast({prediction}{f} as string)" for f in fields)
    long = pairs.select(F.expr(f"stack({len(fields)}, {rows}) as (field, r, p)"))
    r, p = F.col("r"), F.col("p")
    kinds = {
        "correct": r.isNotNull() & p.isNotNull() & (r == p),
        "missing_prediction": r.isNotNull() & p.isNull(),
        "unsupported_prediction": r.isNull() & p.isNotNull(),
        "mismatch": r.isNotNull() & p.isNotNull() & (r != p),
        "both_missing": r.isNull() & p.isNull(),
    }
    out = long.groupBy("field").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    predicted = F.col("correct") + F.col("unsupported_prediction") + F.col("mismatch")
    referred = F.col("correct") + F.col("missing_prediction") + F.col("mismatch")
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    return out.select("*", rate(F.col("correct"), predicted).alias("precision"), rate(F.col("correct"), referred).alias("recall"), rate(F.col("unsupported_prediction") + F.col("mismatch"), predicted).alias("unsupported_rate"))


def match_records(candidates: DataFrame, by: str) -> DataFrame:
    """Global greedy one-to-one matching within each group: best score first, ties by (p, r).

    candidates: by, p, r, score.  A fold over the group's sorted candidates.
    """
    entry = F.struct((-F.col("score")).alias("k"), F.col("p").alias("p"), F.col("r").alias("r"))
    rows = candidates.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    fold = "aggregate(all, slice(all, 1, 0), (acc, x) -> if(exists(acc, m -> m.p = x.p or m.r = x.r), acc, concat(acc, array(x))))"
    return rows.select(by, F.inline(F.expr(fold))).select(by, "p", "r", (-F.col("k")).alias("score"))


def review_fold(events: DataFrame, key: str, order: str, action: str, value: str) -> DataFrame:
    """The state of each record after its review events: last action, last edited value, number of edits."""
    edited = F.col(action) == "edit"
    return events.groupBy(key).agg(
        F.max_by(action, order).alias("status"), F.max_by(value, F.when(edited, F.col(order))).alias("value"), F.count_if(edited).alias("edits")
    )


def strict_sum(value: Column) -> Column:
    """Null if any element is null: missing is not zero."""
    return F.when(F.count("*") == F.count(value), F.sum(value))


def shingles(passages: DataFrame, key: str, width: int = 5, text: str = "text") -> DataFrame:
    """key, shingle of every run of ``width`` words, in the row; shorter texts have none."""
    words = passages.select(key, F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)).alias("__w")).filter(F.size("__w") >= width)
    made = F.expr(f"transform(sequence(1, size(__w) - {width - 1}), i -> array_join(slice(__w, i, {width}), ' '))")
    return words.select(key, F.explode(made).alias("shingle"))


def contained(items: DataFrame, held: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """key, shingles, found of the items of whose distinct shingles ``least`` or more are in ``held``.

    The items' shingles are few; what holds them is cut to them before it is made distinct.
    """
    mine = items.distinct()
    met = held.join(mine.select("shingle").distinct(), "shingle", "left_semi").distinct().withColumn("__found", F.lit(True))
    sums = mine.join(met, "shingle", "left").groupBy(key).agg(F.count("*").alias("shingles"), F.count("__found").alias("found"))
    return sums.filter(F.col("found") >= least * F.col("shingles"))


def cooccurrence(words: DataFrame, pid: str = "pid", term: str = "term") -> DataFrame:
    """source, target, weight: undirected pairs of distinct terms of a passage."""
    once = words.select(pid, term).distinct()
    a, b = once.alias("a"), once.alias("b")
    met = a.join(b, (F.col(f"a.{pid}") == F.col(f"b.{pid}")) & (F.col(f"a.{term}") < F.col(f"b.{term}")))
    return met.groupBy(F.col(f"a.{term}").alias("source"), F.col(f"b.{term}").alias("target")).agg(F.count("*").alias("weight"))


def pending(passages: DataFrame, voters: DataFrame, done: DataFrame) -> DataFrame:
    """(pid, voter) still to do; ``voters`` is a small configuration list."""
    names = [r["voter"] for r in voters.select("voter").distinct().collect()]
    every = passages.select("pid", F.explode(F.array(*[F.lit(v) for v in sorted(names)])).alias("voter"))
    return every.join(done.select("pid", "voter"), ["pid", "voter"], "left_anti")
