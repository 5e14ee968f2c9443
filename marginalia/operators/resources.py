"""Gazetteer resources, passages for annotation, and the small checks of a run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.spans import context


def build_layers(terms: DataFrame, inflect: bool = True) -> DataFrame:
    """layer, term, label, any_case, generated, risk of every term of a layer.

    terms: layer, term, label, any_case, at (the order of the list).  White
    space is trimmed, empty terms go, and of terms that differ in case the first
    stays.  ``inflect`` adds plurals that are no terms themselves; ``risk`` says
    why a curated landscape noun may match too much.
    """
    rows = terms.withColumn("term", F.trim("term")).filter(F.length("term") > 0).withColumn("key", F.lower("term"))
    first = rows.groupBy("layer", "key").agg(*[F.min_by(c, "at").alias(c) for c in ("term", "label", "any_case")])
    first = first.withColumn("generated", F.lit(False)).withColumn("risk", F.when(F.col("label") == "GEONOUN", T.risky_term(F.col("term"))))
    if inflect:
        more = first.select("layer", T.plural(F.col("key")).alias("key"), "label", "any_case").dropDuplicates(["layer", "key"]).join(first.select("layer", "key"), ["layer", "key"], "left_anti")
        first = first.unionByName(more.withColumns({"term": F.col("key"), "generated": F.lit(True), "risk": F.lit(None).cast("string")}))
    return first.select("layer", "term", "label", "any_case", "generated", "risk")


def layer_stats(layers: DataFrame, terms: DataFrame) -> DataFrame:
    """layer, terms, generated, needs_review, dropped: what a bundle holds of each layer, and what of its lists it does not."""
    read = terms.groupBy("layer").agg(F.count("*").alias("read"))
    held = layers.groupBy("layer").agg(F.count_if(~F.col("generated")).alias("terms"), F.count_if("generated").alias("generated"), F.count("risk").alias("needs_review"))
    return held.join(read, "layer").select("layer", "terms", "generated", "needs_review", (F.col("read") - F.col("terms")).alias("dropped"))


def surfaces(layers: DataFrame, curated_only: bool = False) -> DataFrame:
    """surface, label, any_case as :func:`marginalia.operators.spans.gazetteer_spans` reads them, in the order of a table to read: label, term."""
    kept = layers.filter(~F.col("generated")) if curated_only else layers
    return kept.select(F.col("term").alias("surface"), "label", "any_case").distinct().orderBy("label", F.lower("surface"), "surface")


def write_bundle(layers: DataFrame, folder: str) -> None:
    """The bundle as folders of JSON lines and CSV: hybrid, curated_only, layered, review."""
    surfaces(layers).write.mode("overwrite").json(f"{folder}/hybrid")
    surfaces(layers, True).write.mode("overwrite").json(f"{folder}/curated_only")
    layers.write.mode("overwrite").partitionBy("layer").json(f"{folder}/layered")
    layers.filter(F.col("risk").isNotNull()).select("layer", "term", "risk").write.mode("overwrite").csv(f"{folder}/review", header=True)


def harvest(texts: DataFrame, key: str, shortest: int = 45, longest: int = 420, prefix: str = "") -> DataFrame:
    """Candidate passages: key, passage_id, start, end, text, positive, year of the sentences that pass the length and letter filters.

    texts: key, text.  Equal sentences (by letters and digits) are one, the first by (key, start).
    """
    each = T.sentences(texts, [key]).withColumn("text", F.trim("sentence")).filter(T.passage_ok(F.col("text"), shortest, longest))
    same = F.md5(T.dedupe_key(F.col("text")).cast("binary"))
    place = F.struct(F.col(key).alias("k"), F.col("start").alias("s"))
    first = each.groupBy(same.alias("__same")).agg(F.min_by(F.struct(key, "start", "end", "text"), place).alias("x")).select("x.*")
    identified = T.passage_id(F.col(key).cast("string"), F.col("start"), F.col("text"), prefix)
    return first.select(key, identified.alias("passage_id"), "start", "end", "text", T.is_positive(F.col("text")).alias("positive"), T.year_in(F.col("text")).alias("year"))


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are not there, or null, take a default."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def bio(tokens: DataFrame, spans: DataFrame, pid: str = "pid") -> DataFrame:
    """tokens (pid, pos, start, end, word) with ``role``: B-label where a span begins, I-label within it, O elsewhere.

    Of spans that share a token the first by (start, end, label) gives its role.
    """
    from marginalia.operators.spans import by_island

    rows = by_island(pid, t=tokens, s=spans.select(pid, "start", "end", "label"))
    given = "get(filter(s, y -> y.start < x.`end` and x.start < y.`end`), 0)"
    role = f"coalesce(concat(if({given}.start >= x.start, 'B-', 'I-'), {given}.label), 'O')"
    marked = F.expr(f"transform(t, x -> struct(x as v, {role} as role))")
    return rows.select(pid, F.inline(marked)).select(pid, "v.*", "role").select(*tokens.columns, "role")


def addable(new: DataFrame, held: DataFrame, pid: str = "pid") -> DataFrame:
    """The new spans that overlap none that are held already."""
    from marginalia.operators.spans import split_by_overlap

    return split_by_overlap(new, held, pid).filter(~F.col("__met")).drop("__met")


def valid_spans(spans: DataFrame, passages: DataFrame, pid: str = "pid") -> DataFrame:
    """Spans whose offsets lie within their passage and are not empty."""
    met = spans.join(passages.select(pid, F.length("text").alias("__n")), pid)
    return met.filter((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("__n"))).drop("__n")


def scored_labels(spans: DataFrame, labels: list[str], by: str) -> DataFrame:
    """by, emitted, scored, dropped: what of each annotator's spans a layer that covers ``labels`` can score."""
    inside = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    return spans.groupBy(by).agg(F.count("*").alias("emitted"), F.count_if(inside).alias("scored"), F.count_if(~inside).alias("dropped"))


def label_inventory(spans: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share, from the commonest; ties by label."""
    counted = spans.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row a label
    return counted.withColumn("share", F.round(F.col("n") / total, 6)).orderBy(F.desc("n"), label)


def outside(spans: DataFrame, allowed: list[str], by: str) -> DataFrame:
    """by, unexpected (labels that are not allowed, sorted) of the groups that have any."""
    found = spans.groupBy(by).agg(F.array_sort(F.array_except(F.collect_set("label"), F.array(*[F.lit(x) for x in allowed]))).alias("unexpected"))
    return found.filter(F.size("unexpected") > 0)


def expected_found(found: DataFrame, expected: DataFrame, by: str, value: str) -> DataFrame:
    """by, expected, missing: how many of a group's expected values there are, and how many of them were not found."""
    want, have = expected.select(by, value).distinct(), found.select(by, value).distinct().withColumn("__here", F.lit(True))
    return want.join(have, [by, value], "left").groupBy(by).agg(F.count("*").alias("expected"), F.count_if(F.col("__here").isNull()).alias("missing"))


def shares(rows: DataFrame, by: str, flag: Column, least: float = 0.15) -> DataFrame:
    """by, n, share of the rows that ``flag`` holds for, and ``low`` where that is less than ``least``."""
    share = F.avg(F.coalesce(flag, F.lit(False)).cast("double"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(share, 6).alias("share"), (share < least).alias("low"))


def centre(points: DataFrame) -> DataFrame:
    """lat, lon: the mean of points that have both."""
    return points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def needs_review(rows: DataFrame) -> DataFrame:
    """Rows that are ambiguous, unresolved, or marked for review."""
    marked = F.coalesce(F.col("requires_review"), F.lit(False)) | F.coalesce(F.col("status").isin("ambiguous", "unresolved"), F.lit(False))
    return rows.filter(marked)


def failures(telemetry: DataFrame) -> DataFrame:
    """Calls that did not succeed; one without a word on that did."""
    return telemetry.filter(F.col("success") == F.lit(False))


def repeated(rows: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """key, n of keys that are null or not unique; with ``expected``, reading the result fails where the number of rows is another."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"))
    if expected is not None:
        total = rows.agg(F.count("*").alias("rows"))
        wrong = F.raise_error(F.concat(F.lit(f"{expected} rows expected, found "), F.col("rows").cast("string")))
        found = found.join(F.broadcast(total.select(F.when(F.col("rows") != expected, wrong).otherwise(F.lit(True)).alias("__ok"))), F.col("__ok")).drop("__ok")
    return found.filter(F.col(key).isNull() | (F.col("n") > 1))


def queue_with_context(queue: DataFrame, passages: DataFrame, pid: str = "pid", width: int = 60) -> DataFrame:
    """The queue's rows (pid, start, end and others) with ``text`` and ``context``, the span with its surroundings."""
    met = queue.join(passages.select(pid, F.col("text").alias("__text")), pid)
    own = F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start"))
    return met.withColumn("text", own).withColumn("context", context(F.col("__text"), F.col("start"), F.col("end"), width)).drop("__text")


def fingerprint(prompt: str, schema: dict) -> str:
    """Sixteen hexadecimal digits that tell one prompt and answer schema from another."""
    return hashlib.sha256((prompt + json.dumps(schema, sort_keys=True)).encode()).hexdigest()[:16]


def run_manifest(spark: SparkSession, name: str, config: dict, tables: dict[str, DataFrame]) -> str:
    """A run as one JSON object: name, configuration without secrets, engine version, rows and columns of its tables."""
    from marginalia.sources.catalogue import redacted

    seen = {t: {"rows": df.count(), "columns": df.columns} for t, df in tables.items()}
    return json.dumps({"name": name, "config": redacted(config), "engine": spark.version, "tables": seen}, sort_keys=True, ensure_ascii=False)
