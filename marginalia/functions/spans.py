"""Expressions on half-open character spans and on counts of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared characters, 0 where the spans are apart."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union; null for two empty spans."""
    shared = overlap(s1, e1, s2, e2)
    return F.try_divide(shared.cast("double"), (e1 - s1) + (e2 - s2) - shared)


def same_annotation(s1: Column, e1: Column, s2: Column, e2: Column, least_iou: float = 0.5, containment: float = 0.8) -> Column:
    """Whether two spans mark the same thing: enough IoU, or the shorter lies mostly within the other."""
    shared = overlap(s1, e1, s2, e2)
    shorter = F.least(e1 - s1, e2 - s2)
    within = F.coalesce(F.try_divide(shared.cast("double"), shorter), F.lit(0.0))
    return (shared > 0) & ((F.coalesce(iou(s1, e1, s2, e2), F.lit(0.0)) >= least_iou) | (within >= containment))


def precision(tp: Column, fp: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(empty))


def recall(tp: Column, fn: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(empty))


def f1(tp: Column, fp: Column, fn: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(empty))


def context(text: Column, start: Column, end: Column, width: int = 60) -> Column:
    """The span with up to ``width`` characters on either side."""
    first = F.greatest(F.lit(0), start - width)
    return F.substring(text, first + 1, end + width - first)
