"""Affect decisions over score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentiment(positive: Column, negative: Column, neutral: Column) -> Column:
    """``mixed`` where both poles reach 0.25 within 0.20 of each other, else the largest."""
    mixed = (positive >= 0.25) & (negative >= 0.25) & (F.abs(positive - negative) <= 0.20)
    top = F.greatest(positive, negative, neutral)
    return F.when(mixed, "mixed").when(positive == top, "positive").when(negative == top, "negative").otherwise("neutral")


def emotions(scores: Column, neutral: str = "neutral") -> Column:
    """Labels at 0.25 or more; else the single top if it reaches 0.50 and beats neutral; else none."""
    entries = F.filter(F.map_entries(scores), lambda e: e["key"] != neutral)
    many = F.array_sort(F.transform(F.filter(entries, lambda e: e["value"] >= 0.25), lambda e: e["key"]))
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    single = (best["v"] >= 0.5) & (best["v"] > F.coalesce(F.element_at(scores, neutral), F.lit(0.0)))
    return F.when(F.size(many) > 0, many).when(single, F.array(best["k"])).otherwise(F.array().cast("array<string>"))
