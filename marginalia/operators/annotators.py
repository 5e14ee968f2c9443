"""Annotators as plug-ins, the panel that runs them, and what their spans go through."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.records import pending
from marginalia.operators.spans import split_by_overlap

#: text -> [{start, end, label}] (offsets in code points).
Annotator = Callable[[str], list[dict]]
PANEL_FIELDS = "pid long, voter string, spans array<struct<start:int,end:int,label:string>>, error string"


def load(target: str, **options) -> Annotator:
    """An annotator by ``module:attribute``; with options the attribute is called with them."""
    module, _, name = target.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found(**options) if options else found


def parsed(answer: str) -> list[dict]:
    """Spans of a JSON answer, fenced or not: {"spans": [...]} or a list."""
    body = answer.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    found = json.loads(body)
    return found["spans"] if isinstance(found, dict) else found


def run_panel(passages: DataFrame, annotators: dict[str, Annotator], done: DataFrame | None = None) -> DataFrame:
    """pid, voter, spans, error of every passage and annotator that is not in ``done`` (pid, voter).

    A passage that an annotator fails on has no spans and says why; it does not
    stop the run.  Offsets outside the text are a failure too.
    """
    spark = passages.sparkSession
    done = done if done is not None else spark.createDataFrame([], "pid long, voter string")
    names = spark.createDataFrame([(v,) for v in sorted(annotators)], "voter string")
    work = pending(passages, names, done).join(passages.select("pid", "text"), "pid")

    def annotate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans, errors = [], []
            for voter, text in zip(frame["voter"], frame["text"], strict=True):
                try:
                    got = [{"start": int(s["start"]), "end": int(s["end"]), "label": s["label"]} for s in annotators[voter](text or "")]
                    if any(not 0 <= s["start"] < s["end"] <= len(text or "") for s in got):
                        raise ValueError("offsets outside the text")
                    spans.append(got)
                    errors.append(None)
                except Exception as fault:  # noqa: BLE001 - an annotator's fault is a result
                    spans.append([])
                    errors.append(f"{type(fault).__name__}: {fault}")
            yield pd.DataFrame({"pid": frame["pid"], "voter": frame["voter"], "spans": spans, "error": pd.Series(errors, dtype=object)})

    return work.mapInPandas(annotate, PANEL_FIELDS)


def suppressed(spans: DataFrame, taken: DataFrame, pid: str = "pid") -> DataFrame:
    """The spans that overlap none of ``taken``: a dictionary's hit beats a model's."""
    return split_by_overlap(spans, taken, pid).filter(~F.col("__met")).drop("__met")


def gold_label(clusters: DataFrame, gold: DataFrame, pid: str = "pid", hit: str = "PLACE", miss: str = "REJECT") -> DataFrame:
    """clusters with ``gold``: ``hit`` where any gold span overlaps, else ``miss``."""
    marked = split_by_overlap(clusters, gold, pid)
    return marked.withColumn("gold", F.when(F.col("__met"), hit).otherwise(miss)).drop("__met")


def without(spans: DataFrame, excluded: DataFrame, pid: str = "pid") -> DataFrame:
    """Spans but for (voter, passage) pairs that the voter may have seen before."""
    return spans.join(excluded.select("voter", pid).distinct(), ["voter", pid], "left_anti")


def snapped(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Offsets moved outwards to the ends of the words that they cut; ``$`` would also match before a last line break."""
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"[\p{L}\p{N}]*\z", 0))
    after = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[\p{L}\p{N}]*", 0))
    cut = lambda at: F.substring(text, at, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    return F.when(cut(start + 1), start - before).otherwise(start), F.when(cut(end), end + after).otherwise(end)


def span_of_tokens(tokens: DataFrame, i: Column, j: Column, pid: str = "pid") -> DataFrame:
    """pid, start, end from the first to the last token, in either order, without the last one's punctuation.

    tokens: pid, pos, start, end, word, and the columns that ``i`` and ``j`` read.
    """
    lo, hi = F.least(i, j), F.greatest(i, j)
    bare = F.length(F.regexp_replace("word", r"[^\p{L}\p{N}]+$", ""))
    inside = tokens.filter(F.col("pos").between(lo, hi))
    out = inside.groupBy(pid).agg(F.min("start").alias("start"), F.max_by(F.col("start") + F.when(bare > 0, bare).otherwise(F.length("word")), "pos").alias("end"))
    return out


def find_phrases(passages: DataFrame, phrases: DataFrame, pid: str = "pid") -> DataFrame:
    """pid, phrase, label, start, end of a phrase's first place in its passage; null where it is not there."""
    met = phrases.join(passages.select(pid, "text"), pid)
    at = F.when(F.length("phrase") > 0, F.nullif(F.expr("position(phrase, text)"), F.lit(0))) - 1
    return met.select(pid, "phrase", "label", at.alias("start"), (at + F.length("phrase")).alias("end"))


def by_system(spans: DataFrame, pid: str = "pid") -> DataFrame:
    """pid, systems: a map of each voter to its spans in order, for caches that are read passage by passage."""
    per = spans.groupBy(pid, "voter").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    return per.groupBy(pid).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("voter", "spans")))).alias("systems"))
