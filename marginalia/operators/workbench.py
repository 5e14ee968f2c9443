"""Small steps around a run: selections, relabelling, generated records, exact look-ups, edit logs, gates of a formal run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.records import hash_sample


def in_gold(rows: DataFrame, gold: DataFrame, key: str = "pid") -> DataFrame:
    """The rows of passages that the references know; a passage's references are counted once."""
    return rows.join(gold.select(key).distinct(), key, "left_semi")


def collapsed(spans: DataFrame, label: str = "PLACE") -> DataFrame:
    """Spans under one label, equal ones once, for a layer that doesn't tell labels apart."""
    return spans.withColumn("label", F.lit(label)).distinct()


def harmonised(spans: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Spans with the label that ``mapping`` gives theirs, kept as ``model_label``; spans of other labels go."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else F.create_map().cast("map<string,string>")
    return spans.withColumn("model_label", F.col("label")).withColumn("label", F.try_element_at(known, F.col("label"))).filter(F.col("label").isNotNull())


def mapped(rows: DataFrame, column: str, mapping: dict[str, str], default: str) -> DataFrame:
    """``column`` by a small table (trimmed, any case); ``default`` where it has no entry or the value is null."""
    value = F.lower(F.trim(F.col(column)))
    cases = F.lit(None).cast("string")
    for given, wanted in mapping.items():
        cases = F.coalesce(cases, F.when(value == given.strip().lower(), F.lit(wanted)))
    return rows.withColumn(column, F.coalesce(cases, F.lit(default)))


def selections(rows: DataFrame, wanted: dict[str, dict[str, str]]) -> DataFrame:
    """The rows of each named selection (column = value, all of them) under ``selection``, in one pass; a row may be in several."""
    inside = [F.when(F.lit(True) if not of else _all([F.col(c) == F.lit(v) for c, v in of.items()]), F.lit(name)) for name, of in wanted.items()]
    return rows.withColumn("selection", F.explode(F.array_compact(F.array(*inside))))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order: the feature is the limit."""
    return rows.orderBy(*order).limit(n)


def templated(spark: SparkSession, n: int, template: str, **lists: list[str]) -> DataFrame:
    """id, text and the parts of ``n`` records: every combination of the lists' values in turn, the last list changing fastest.

    ``template`` names its parts in braces.  Beyond the number of combinations they begin again.
    """
    rows, below = spark.range(n), 1
    for name, values in reversed(lists.items()):
        at = F.expr(f"cast((id div {below}) % {len(values)} as int)")
        rows = rows.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), at + 1))
        below *= len(values)
    text = F.lit(template)
    for name in lists:
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
    return rows.withColumn("text", text)


def exact_lookup(requests: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """requests with ``value``: their own where they have one, else the cached one of the same key and the very same text; ``origin`` says which.

    A key's cached texts are told apart by their hash; of repeated entries the least value counts.
    """
    digest = F.sha2(F.col("text"), 256)
    held = cached.groupBy(F.col(key).alias("__key"), digest.alias("__sha")).agg(F.min(value).alias("__held"))
    met = requests.withColumn("__asked", digest).join(held, (F.col(key) == F.col("__key")) & (F.col("__asked") == F.col("__sha")), "left")
    origin = F.when(F.col(value).isNotNull(), "live").when(F.col("__held").isNotNull(), "cached").otherwise("none")
    return met.withColumn("origin", origin).withColumn(value, F.coalesce(F.col(value), F.col("__held"))).drop("__key", "__sha", "__held", "__asked")


def surviving(events: DataFrame, by: str, order: str) -> DataFrame:
    """by, kept: what an edit log leaves, in order; ``action`` add puts ``item`` on, undo takes the last one off, clear takes all.

    A session's log is one array, since each step depends on those before; an undo of nothing does nothing.
    """
    log = events.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col("action"), F.col("item")))).alias("log"))
    item = events.schema["item"].dataType.simpleString()
    fold = f"""aggregate(log, cast(array() as array<{item}>), (a, e) -> case when e.action = 'add' then array_append(a, e.item)
      when e.action = 'clear' then cast(array() as array<{item}>) when e.action = 'undo' and size(a) > 0 then slice(a, 1, size(a) - 1) else a end)"""
    return log.select(by, F.expr(fold).alias("kept"))


def formal(rows: DataFrame, status: Column, checksum: str | None, expected: str, commit: str | None, subset: bool = False) -> DataFrame:
    """The rows of a run that may be published; fails for a subset, without a commit, with another checksum, or when a row is read whose ``status`` is provisional or pending."""
    wrong = [what for what, bad in (("a subset", subset), ("no commit", not commit), ("another checksum", checksum != expected)) if bad]
    if wrong:
        raise ValueError(f"not a formal run: {', '.join(wrong)}")
    open_ = F.coalesce(F.lower(status).rlike("provisional|pending"), F.lit(False))
    return rows.withColumn("__ok", F.when(open_, F.raise_error(F.lit("not a formal run: a row is not final"))).otherwise(F.lit(True))).filter("__ok").drop("__ok")


def as_objects(examples: DataFrame, spans: DataFrame, pid: str = "pid") -> DataFrame:
    """pid, json: one object an example with its text, the text's hash and its spans in order (none: an empty list)."""
    fields = [c for c in spans.columns if c != pid]
    first = F.struct(*[F.col(c) for c in ("start", "end")], *[F.col(c) for c in fields if c not in ("start", "end")])
    held = spans.groupBy(pid).agg(F.array_sort(F.collect_list(first)).alias("spans"))
    met = examples.select(pid, "text").join(held, pid, "left")
    empty = F.array().cast(held.schema["spans"].dataType)
    return met.select(pid, F.to_json(F.struct(pid, "text", F.sha2("text", 256).alias("text_sha256"), F.coalesce("spans", empty).alias("spans"))).alias("json"))


def write_gazetteer(entries: DataFrame, path: str) -> None:
    """CSV by label, then surface in lower case."""
    entries.orderBy("label", F.lower("text"), "text").write.csv(path, header=True)


def write_sample(passages: DataFrame, path: str, n: int = 25, key: str = "pid", seed: str = "2026") -> None:
    """The texts of ``n`` passages drawn by hash, a line each."""
    flat = F.regexp_replace("text", r"\s+", " ")
    hash_sample(passages, key, n, seed).select(flat.alias("value")).filter("value is not null").write.text(path)
